"""One query for each operator over graphs derived from the tables, and its SQL for DuckDB.

A query that SQL can't say has none and is tested against brute force.  Witnesses that are
not unique (a cycle, a matching, a trail, a flow) are reported by what is.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import NegativeWeightError
from .graph import GraphBuilder, PropertyGraph
from .hypergraph import Hypergraph
from .operators import centrality, connectivity, euler, flow, matching, metrics, paths, setops, spanning, structure, traversal
from .plans.lineage import cut, discard
from .sources import derived, documents, generate, text_formats
from .sources.derived import CONV_CHAIN, EVENT_FLOW, GEO_TREE, NATION_FLOW, SUPP_PART, copurchase_sql, part_seq_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 8


def query(sql: str | None = None):
    """Registers a query, and its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def longs(*cols: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in cols]


HI, MID = copurchase_sql(48), copurchase_sql(45)

#: The part of a connected copurchase graph: the component of the smallest id among the largest ones.
REACH_HI = f"""{HI},
cr AS (SELECT id, id AS other FROM cv UNION SELECT r.id, a.dst FROM cr r JOIN ca a ON a.src = r.other),
cc AS (SELECT id, min(other) AS component FROM cr GROUP BY id)"""


def giant(g: PropertyGraph) -> PropertyGraph:
    """The largest component; of equal ones that of the smallest id."""
    c = cut(connectivity.connected_components(g))
    best = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return setops.subgraph(g, c.join(F.broadcast(best), "component").select("id")).freeze()


GIANT = """,
cb AS (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
gv AS (SELECT id FROM cc WHERE component = (SELECT component FROM cb)),
ga AS (SELECT * FROM ca WHERE src IN (SELECT id FROM gv))"""

# -- containers -------------------------------------------------------------------------------


@query(f"WITH {NATION_FLOW} SELECT src, dst, weight FROM ne")
def c1_edges(spark, sf_dir):
    return derived.nation_flow(spark, sf_dir).scan_edges().select("src", "dst", "weight")


@query(f"WITH {NATION_FLOW} SELECT (SELECT count(*) FROM nv) AS vertices, (SELECT count(*) FROM ne) AS edges")
def c2_counts(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    return row(spark, vertices=g.vertex_count(), edges=g.edge_count())


@query("SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def c3_contains_vertices(spark, sf_dir):
    line = derived.table(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    g = PropertyGraph.from_dataframes(line.select(F.col("l_partkey").alias("src"), F.col("l_partkey").alias("dst")).distinct())
    return g.contains_vertices(derived.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query(f"WITH {HI} SELECT p.src, p.dst FROM (SELECT dst AS src, src AS dst FROM ce UNION ALL SELECT src, dst + 1 FROM ce) p JOIN ca a ON a.src = p.src AND a.dst = p.dst")
def c4_contains_edges(spark, sf_dir, least=48):
    g = derived.copurchase_pairs(spark, sf_dir, least)
    e = g.edges.select("src", "dst")
    asked = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).unionByName(e.select("src", (F.col("dst") + 1).alias("dst")))
    return g.contains_edges(asked)


@query(f"WITH {EVENT_FLOW}, k AS (SELECT min(src) AS t FROM ee) SELECT event_id AS eid FROM ee, k WHERE src = t AND dst = t")
def c5_get_edges(spark, sf_dir):
    g = derived.event_flow(spark, sf_dir)
    t = g.vertices.agg(F.min("id")).first()[0]
    return g.get_edges(t, t).select("eid")


@query(f"WITH {SUPP_PART} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM se UNION ALL SELECT dst FROM se) GROUP BY id")
def c6_degrees(spark, sf_dir):
    return derived.supp_part(spark, sf_dir).degrees()


@query(f"""WITH {NATION_FLOW} SELECT id, (SELECT count(*) FROM ne WHERE src = id) AS out_degree,
    (SELECT count(*) FROM ne WHERE dst = id) AS in_degree FROM nv""")
def c7_in_out_degrees(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    return g.out_degrees().join(g.in_degrees(), "id")


@query(f"""WITH {NATION_FLOW} SELECT 'out' AS kind, src, dst, weight FROM ne WHERE src = 3
    UNION ALL SELECT 'in', src, dst, weight FROM ne WHERE dst = 3""")
def c8_out_in_edges(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    part = lambda kind, e: e.select(F.lit(kind).alias("kind"), "src", "dst", "weight")
    return part("out", g.out_edges(3)).unionByName(part("in", g.in_edges(3)))


@query(f"WITH {NATION_FLOW} SELECT src, dst, weight FROM ne WHERE src = 7 OR dst = 7")
def c9_adjacent_edges(spark, sf_dir):
    return derived.nation_flow(spark, sf_dir).adjacent_edges(7).select("src", "dst", "weight")


@query(f"WITH {HI} SELECT id FROM cv UNION SELECT CAST(p_partkey AS BIGINT) FROM part WHERE p_size = 1")
def c10_add_vertices(spark, sf_dir, least=48):
    new = derived.table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"))
    return derived.copurchase_pairs(spark, sf_dir, least).add_vertices(new).vertices.select("id")


@query(f"""WITH {NATION_FLOW} SELECT src, dst, weight FROM ne
    UNION ALL SELECT a.id, b.id, 0 FROM nv a, nv b WHERE NOT EXISTS (SELECT 1 FROM ne WHERE src = a.id AND dst = b.id)""")
def c11_add_edges(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    full = generate.erdos_renyi(spark, g.vertex_count(), 1.0, 0, True).edges.select("src", "dst")
    loops = g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return g.add_edges(full.unionByName(loops).withColumn("weight", F.lit(0).cast("long"))).edges.select("src", "dst", "weight")


@query(f"WITH {NATION_FLOW} SELECT src, dst, weight FROM ne WHERE src % 3 <> 0 AND dst % 3 <> 0")
def c12_remove_vertices(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    return g.remove_vertices(g.vertices.where("id % 3 = 0")).edges.select("src", "dst", "weight")


@query(f"WITH {NATION_FLOW}, k AS (SELECT src AS s, dst AS t FROM ne ORDER BY 1, 2 LIMIT 1) SELECT src, dst, weight FROM ne, k WHERE NOT (src = s AND dst = t)")
def c13_remove_edge(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    e = g.edges.orderBy("src", "dst").first()
    return g.remove_edge(e["src"], e["dst"], weight=e["weight"]).edges.select("src", "dst", "weight")


@query("SELECT CAST(0 AS BIGINT) AS vertices, CAST(0 AS BIGINT) AS edges")
def c14_clear(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir).clear()
    return row(spark, vertices=g.vertex_count(), edges=g.edge_count())


@query(f"WITH {CONV_CHAIN} SELECT src, dst FROM te")
def c15_dag_add_edges(spark, sf_dir):
    g = derived.conv_chain(spark, sf_dir)
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    loops = g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return g.add_edges_acyclic(back.unionByName(loops)).edges.select("src", "dst")


@query(f"WITH {NATION_FLOW} SELECT src, dst FROM ne")
def c16_freeze(spark, sf_dir):
    return derived.nation_flow(spark, sf_dir).as_read_only().freeze().edges.select("src", "dst")


@query("SELECT CAST(r_regionkey AS BIGINT) AS src, CAST(n_nationkey + 100 AS BIGINT) AS dst FROM region JOIN nation ON r_regionkey = n_regionkey")
def c17_builder(spark, sf_dir):
    # the builder is for graphs that a program makes up; region and nation have fixed sizes
    rows = derived.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").orderBy("n_nationkey").collect()
    b = GraphBuilder(spark).add_vertices(sorted({r[0] for r in rows}))
    for r in rows:
        b.add_edge(r[0], r[1] + 100)
    return b.build().edges.select("src", "dst")


# -- traversal --------------------------------------------------------------------------------

TREE = f"""{GEO_TREE},
gw AS (
    SELECT CAST(1 AS BIGINT) AS id, 0 AS level, [CAST(1 AS BIGINT)] AS path
    UNION ALL SELECT ge.dst, level + 1, list_append(path, ge.dst) FROM gw JOIN ge ON ge.src = gw.id
)"""


@query(f"WITH RECURSIVE {TREE} SELECT id, level, row_number() OVER (ORDER BY level, path) - 1 AS pos FROM gw")
def t1_bfs(spark, sf_dir):
    return traversal.bfs(derived.geo_tree(spark, sf_dir), 1).select("id", F.col("level"), "pos")


@query(f"WITH RECURSIVE {TREE} SELECT id, row_number() OVER (ORDER BY path) - 1 AS pos FROM gw")
def t2_dfs(spark, sf_dir):
    return traversal.dfs(derived.geo_tree(spark, sf_dir), 1)


@query(f"WITH RECURSIVE {TREE} SELECT id, row_number() OVER (ORDER BY list_append(path, 9000000000000000000)) - 1 AS pos FROM gw")
def t3_dfs_post_order(spark, sf_dir):
    return traversal.dfs(derived.geo_tree(spark, sf_dir), 1, post_order=True)


@query(f"""WITH RECURSIVE {CONV_CHAIN}, {HI},
    n AS (SELECT count(*) AS e FROM ce),
    cr AS (SELECT id, id AS other FROM cv UNION SELECT r.id, a.dst FROM cr r JOIN ca a ON a.src = r.other),
    k AS (SELECT count(DISTINCT c) AS c FROM (SELECT id, min(other) AS c FROM cr GROUP BY id))
    SELECT EXISTS (SELECT 1 FROM te WHERE dst < src) AS chains, (SELECT e FROM n) > (SELECT count(*) FROM cv) - (SELECT c FROM k) AS copurchase""")
def t4_has_cycle(spark, sf_dir, least=48):
    chains, pairs = derived.conv_chain(spark, sf_dir), derived.copurchase_pairs(spark, sf_dir, least)
    return row(spark, chains=traversal.has_cycle(chains), copurchase=traversal.has_cycle(pairs))


@query("SELECT true AS found, true AS closed, true AS simple")
def t5_find_cycle(spark, sf_dir):
    g = derived.part_seq(spark, sf_dir, None)
    cycle = traversal.find_cycle(g) or []
    steps = spark.createDataFrame(list(zip(cycle, cycle[1:] + cycle[:1])) or [(-1, -1)], "src long, dst long")
    return row(spark, found=bool(cycle), closed=g.contains_edges(steps).count() == len(cycle), simple=len(set(cycle)) == len(cycle))


@query(f"""WITH RECURSIVE {GEO_TREE},
    w AS (
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 0 AS level, [CAST(r_regionkey AS BIGINT)] AS path FROM region
        UNION ALL SELECT ge.dst, level + 1, list_append(path, ge.dst) FROM w JOIN ge ON ge.src = w.id
    ) SELECT id, level, row_number() OVER (ORDER BY level, path) - 1 AS pos FROM w""")
def t6_topological_order(spark, sf_dir):
    return traversal.topological_order(derived.geo_tree(spark, sf_dir)).select("id", "level", "pos")


# -- connectivity -----------------------------------------------------------------------------


@query(f"WITH RECURSIVE {REACH_HI} SELECT id, component FROM cc")
def n1_connected_components(spark, sf_dir, least=48):
    return connectivity.connected_components(derived.copurchase_pairs(spark, sf_dir, least))


@query(f"WITH RECURSIVE {REACH_HI} SELECT count(DISTINCT component) <= 1 AS connected FROM cc")
def n2_is_connected(spark, sf_dir, least=48):
    return row(spark, connected=connectivity.is_connected(derived.copurchase_pairs(spark, sf_dir, least)))


@query(f"WITH {CONV_CHAIN} SELECT id, min(id) OVER (PARTITION BY conv_id) AS component FROM tt")
def n3_weak_components(spark, sf_dir):
    return connectivity.weakly_connected_components(derived.conv_chain(spark, sf_dir))


SCC = f"""{part_seq_sql(46)},
pr AS (SELECT src, dst FROM pe UNION SELECT r.src, e.dst FROM pr r JOIN pe e ON e.src = r.dst),
ps AS (
    SELECT v.id, least(v.id, coalesce(min(a.dst), v.id)) AS component
    FROM pv v LEFT JOIN (SELECT a.src, a.dst FROM pr a JOIN pr b ON b.src = a.dst AND b.dst = a.src) a ON a.src = v.id GROUP BY v.id
)"""


@query(f"WITH RECURSIVE {SCC} SELECT id, component FROM ps")
def n4_strong_components(spark, sf_dir, least=46):
    return connectivity.strongly_connected_components(derived.part_seq(spark, sf_dir, least))


def _without_edge(extra: str) -> str:
    """Vertices that an edge's end still reaches when the edge is taken out, components being small."""
    return f"""{REACH_HI},
br AS (
    SELECT e.src AS bs, e.dst AS bt, e.src AS pos FROM ce e
    UNION SELECT b.bs, b.bt, a.dst FROM br b JOIN ca a ON a.src = b.pos
    WHERE NOT (a.src = b.bs AND a.dst = b.bt) AND NOT (a.src = b.bt AND a.dst = b.bs)
){extra}"""


@query(f"WITH RECURSIVE {_without_edge('')} SELECT src, dst FROM ce WHERE NOT EXISTS (SELECT 1 FROM br WHERE bs = src AND bt = dst AND pos = dst)")
def n5_bridges(spark, sf_dir, least=48):
    return connectivity.find_bridges(derived.copurchase_pairs(spark, sf_dir, least)).select("src", "dst")


@query(f"""WITH RECURSIVE {REACH_HI},
    ar AS (
        SELECT c.id AS gone, min(a.dst) AS at FROM cc c JOIN ca a ON a.src = c.id GROUP BY c.id
        UNION SELECT r.gone, a.dst FROM ar r JOIN ca a ON a.src = r.at WHERE a.dst <> r.gone
    ),
    size AS (SELECT component, count(*) AS n FROM cc GROUP BY component)
    SELECT gone AS id FROM ar JOIN cc ON cc.id = gone JOIN size USING (component) GROUP BY gone, n HAVING count(*) < n - 1""")
def n6_articulation_points(spark, sf_dir, least=48):
    return connectivity.find_articulation_points(derived.copurchase_pairs(spark, sf_dir, least))


@query(f"""WITH RECURSIVE {SCC}, ed AS (
        SELECT DISTINCT a.component AS s, b.component AS t FROM pe JOIN ps a ON a.id = src JOIN ps b ON b.id = dst WHERE a.component <> b.component
    ) SELECT (SELECT count(DISTINCT component) FROM ps) AS components, (SELECT count(*) FROM ed) AS edges, true AS downward""")
def n7_condense(spark, sf_dir, least=46):
    members, edges = connectivity.condense(derived.part_seq(spark, sf_dir, least))
    return row(spark, components=members.select("component").distinct().count(), edges=edges.count(), downward=edges.where("src <= dst").isEmpty())


# -- paths ------------------------------------------------------------------------------------

def walks(arcs: str, start: str, rounds: int) -> str:
    """Bellman-Ford rounds as a chain of expressions over (src, dst, weight)."""
    parts = [f"d0 AS ({start})"]
    for k in range(1, rounds + 1):
        parts.append(
            f"d{k} AS (SELECT id, min(distance) AS distance FROM (SELECT * FROM d{k - 1} UNION ALL "
            f"SELECT a.dst, d.distance + a.weight FROM d{k - 1} d JOIN {arcs} a ON a.src = d.id) GROUP BY id)"
        )
    return ", ".join(parts)


FROM_ZERO = "SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS distance"
NATION_WALKS = f"{NATION_FLOW}, {walks('ne', FROM_ZERO, 12)}"


@query(f"WITH {NATION_WALKS} SELECT distance FROM d12 WHERE id = 17")
def p2_dijkstra(spark, sf_dir):
    found = paths.Dijkstra("weight").find_path(derived.nation_flow(spark, sf_dir), 0, 17)
    return row(spark, distance=found.distance)


@query(f"WITH {NATION_WALKS} SELECT id, distance FROM d12")
def p3_dijkstra_all(spark, sf_dir):
    return paths.Dijkstra("weight").find_paths_from(derived.nation_flow(spark, sf_dir), 0).distances


@query(f"""WITH {NATION_FLOW}, tilted AS (SELECT src, dst, weight + 10000 * (dst - src) AS weight FROM ne), {walks('tilted', FROM_ZERO, 24)}
    SELECT id, distance FROM d24""")
def p4_bellman_ford(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    # a potential makes weights negative without making a negative cycle
    tilted = g.with_edges(g.edges.withColumn("weight", F.col("weight") + 10000 * (F.col("dst") - F.col("src"))))
    return paths.BellmanFord("weight").find_paths_from(tilted, 0).distances


@query(f"WITH {NATION_WALKS} SELECT n.strategy, distance FROM d12, (VALUES ('Dijkstra'), ('BellmanFord'), ('AStar')) n(strategy) WHERE id = 17")
def p1_strategies(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    strategies: list[paths.ShortestPathAlgorithm] = [paths.Dijkstra("weight"), paths.BellmanFord("weight"), paths.AStar("weight", lambda a, b: 0)]
    rows = [(type(s).__name__, s.find_path(g, 0, 17).distance) for s in strategies]
    return spark.createDataFrame(rows, "strategy string, distance long")


def manhattan(a: int, b: int) -> int:
    return abs(a % 20 - b % 20) + abs(a // 20 - b // 20)


@query("""WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)
    SELECT k * 16 % 400 AS target, k * 16 % 400 % 20 + k * 16 % 400 // 20 AS distance, k * 16 % 400 % 20 + k * 16 % 400 // 20 + 1 AS vertices FROM n WHERE k < 6""")
def p5_a_star(spark, sf_dir):
    """Manhattan distances guide the search on a grid of 20 by 20, to vertices named by nations."""
    targets = sorted(16 * r[0] % 400 for r in derived.table(spark, sf_dir, "nation").where("n_nationkey < 6").select("n_nationkey").collect())
    g = generate.grid(spark, 20, 20)
    g = g.with_edges(g.edges.withColumn("weight", F.lit(1).cast("long"))).freeze()
    found = [paths.AStar("weight", manhattan).find_path(g, 0, t) for t in targets]
    return spark.createDataFrame([(t, f.distance, len(f.path)) for t, f in zip(targets, found)], "target long, distance long, vertices long")


def doubled(rounds: int) -> str:
    parts = ["m0 AS (SELECT s, t, min(d) AS d FROM (SELECT src AS s, dst AS t, weight AS d FROM ne UNION ALL SELECT id, id, 0 FROM nv) GROUP BY 1, 2)"]
    for k in range(1, rounds + 1):
        parts.append(f"m{k} AS (SELECT a.s, b.t, min(a.d + b.d) AS d FROM m{k - 1} a JOIN m{k - 1} b ON a.t = b.s GROUP BY 1, 2)")
    return ", ".join(parts)


@query(f"WITH {NATION_FLOW}, {doubled(4)} SELECT s AS source, t AS target, CAST(d AS BIGINT) AS distance FROM m4")
def p6_floyd_warshall(spark, sf_dir):
    return paths.FloydWarshall("weight").compute(derived.nation_flow(spark, sf_dir)).rows


@query(f"WITH {NATION_WALKS} SELECT true AS reachable, distance, true AS connected FROM d12 WHERE id = 9")
def p7_shortest_path(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    found = paths.shortest_path(g, 0, 9)
    steps = spark.createDataFrame(list(zip(found.path, found.path[1:])), "src long, dst long")
    return row(spark, reachable=found.is_reachable, distance=found.distance, connected=g.contains_edges(steps).count() == len(found.path) - 1)


@query(f"WITH RECURSIVE {TREE} SELECT id, CAST(level AS BIGINT) AS distance FROM gw")
def p8_shortest_paths_from(spark, sf_dir):
    return paths.shortest_paths_from(derived.geo_tree(spark, sf_dir), 1, weight=None).distances


@query(f"""WITH RECURSIVE {TREE} SELECT n_nationkey + 100 AS target, gw.id IS NOT NULL AS reachable, CAST(gw.level AS BIGINT) AS distance,
    array_to_string(gw.path, ',') AS path FROM nation LEFT JOIN gw ON gw.id = n_nationkey + 100""")
def p9_result(spark, sf_dir):
    g = derived.geo_tree(spark, sf_dir)
    found = paths.shortest_paths_from(g, 1, weight=None)
    nations = [int(r[0]) + 100 for r in derived.table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    rows = [(t, found.is_reachable(t), found.to(t)) for t in nations]
    return spark.createDataFrame(
        [(t, r, p.distance if r else None, ",".join(map(str, p.path)) if r else None) for t, r, p in rows],
        "target int, reachable boolean, distance long, path string",
    )


@query(f"WITH {CONV_CHAIN}, k AS (SELECT min(conv_id) AS c FROM tt) SELECT id, row_number() OVER (ORDER BY turn) - 1 AS pos FROM tt, k WHERE conv_id = c")
def p10_path(spark, sf_dir):
    g = derived.conv_chain(spark, sf_dir)
    first = g.vertices.agg(F.min("id")).first()[0]
    last = g.vertices.where(F.floor(F.col("id") / 1000) == first // 1000).agg(F.max("id")).first()[0]
    path = paths.shortest_path(g, first, last).path
    return spark.createDataFrame([(v, k) for k, v in enumerate(path)], "id long, pos long")


CHAIN_FROM = f"""{CONV_CHAIN}, k AS (SELECT min(conv_id) AS c FROM tt),
x AS (SELECT id, coalesce(sum(size) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS total,
    first_value(size) OVER (ORDER BY turn) AS first FROM tt, k WHERE conv_id = c)"""


@query(f"WITH {CHAIN_FROM} SELECT id, CAST(total - first AS BIGINT) AS distance FROM x")
def p11_dag_shortest(spark, sf_dir):
    g = derived.conv_chain(spark, sf_dir)
    return paths.dag_shortest_paths_from(g, g.vertices.agg(F.min("id")).first()[0]).distances


@query(f"WITH {CHAIN_FROM} SELECT id, CAST(total - first AS BIGINT) AS distance FROM x")
def p12_dag_longest(spark, sf_dir):
    g = derived.conv_chain(spark, sf_dir)
    return paths.dag_longest_paths_from(g, g.vertices.agg(F.min("id")).first()[0]).distances


@query(f"""WITH {CONV_CHAIN}, s AS (
        SELECT conv_id, sum(size) - min_by(size, turn) AS total, count(*) AS n FROM tt GROUP BY conv_id
    ) SELECT CAST(max(total) AS BIGINT) AS distance FROM s""")
def p13_critical_path(spark, sf_dir):
    return row(spark, distance=paths.critical_path(derived.conv_chain(spark, sf_dir)).distance)


# -- distances --------------------------------------------------------------------------------

GIANT_HOPS = f"""{REACH_HI}{GIANT},
h AS (
    SELECT id AS s, id AS t, 0 AS d, [id] AS seen FROM gv
    UNION ALL SELECT h.s, a.dst, d + 1, list_append(seen, a.dst) FROM h JOIN ga a ON a.src = h.t WHERE NOT list_contains(seen, a.dst)
),
gd AS (SELECT s, t, min(d) AS d FROM h GROUP BY s, t),
ecc AS (SELECT s AS id, max(d) AS e FROM gd GROUP BY s)"""


def _giant(spark, sf_dir, least) -> PropertyGraph:
    return giant(derived.copurchase_pairs(spark, sf_dir, least))


@query(f"WITH RECURSIVE {GIANT_HOPS} SELECT id, CAST(e AS BIGINT) AS eccentricity FROM ecc")
def m1_eccentricities(spark, sf_dir, least=48):
    return metrics.eccentricities(_giant(spark, sf_dir, least))


@query(f"WITH RECURSIVE {GIANT_HOPS} SELECT CAST(max(e) AS BIGINT) AS diameter FROM ecc")
def m2_diameter(spark, sf_dir, least=48):
    return row(spark, diameter=metrics.diameter(_giant(spark, sf_dir, least)))


@query(f"WITH RECURSIVE {GIANT_HOPS} SELECT CAST(min(e) AS BIGINT) AS radius FROM ecc")
def m3_radius(spark, sf_dir, least=48):
    return row(spark, radius=metrics.radius(_giant(spark, sf_dir, least)))


@query(f"WITH RECURSIVE {GIANT_HOPS} SELECT id FROM ecc WHERE e = (SELECT min(e) FROM ecc)")
def m4_center(spark, sf_dir, least=48):
    return metrics.center(_giant(spark, sf_dir, least))


@query(f"WITH RECURSIVE {GIANT_HOPS} SELECT id FROM ecc WHERE e = (SELECT max(e) FROM ecc)")
def m5_periphery(spark, sf_dir, least=48):
    return metrics.periphery(_giant(spark, sf_dir, least))


@query(f"WITH RECURSIVE {GIANT_HOPS} SELECT round(sum(d) / (count(*) - count(DISTINCT s)), {DIGITS}) AS average FROM gd")
def m6_average_path_length(spark, sf_dir, least=48):
    return row(spark, average=round(metrics.average_path_length(_giant(spark, sf_dir, least)), DIGITS))


@query(f"WITH {NATION_FLOW}, {doubled(4)} SELECT CAST(max(e) AS BIGINT) AS diameter, CAST(min(e) AS BIGINT) AS radius FROM (SELECT s, max(d) AS e FROM m4 GROUP BY s)")
def m7_weighted_metrics(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    return row(spark, diameter=metrics.diameter(g, "weight"), radius=metrics.radius(g, "weight"))


# -- centrality -------------------------------------------------------------------------------


@query(f"""WITH {NATION_FLOW}, n AS (SELECT count(*) AS n FROM nv)
    SELECT id, round(((SELECT count(*) FROM ne WHERE src = id) + (SELECT count(*) FROM ne WHERE dst = id)) / (n - 1), {DIGITS}) AS score FROM nv, n""")
def k1_degree_centrality(spark, sf_dir):
    return rounded(centrality.degree_centrality(derived.nation_flow(spark, sf_dir)), "score")


ALL_HOPS = f"""{HI},
h AS (
    SELECT id AS s, id AS t, 0 AS d, [id] AS seen FROM cv
    UNION ALL SELECT h.s, a.dst, d + 1, list_append(seen, a.dst) FROM h JOIN ca a ON a.src = h.t WHERE NOT list_contains(seen, a.dst)
),
hd AS (SELECT s, t, min(d) AS d FROM h GROUP BY s, t)"""


@query(f"""WITH RECURSIVE {ALL_HOPS}, n AS (SELECT count(*) AS n FROM cv)
    SELECT s AS id, round((count(*) - 1) / (n - 1) * (count(*) - 1) / sum(d), {DIGITS}) AS score FROM hd, n GROUP BY s, n""")
def k2_closeness(spark, sf_dir, least=48):
    return rounded(centrality.closeness_centrality(derived.copurchase_pairs(spark, sf_dir, least)), "score")


@query(f"""WITH {NATION_FLOW}, {doubled(4)}, n AS (SELECT count(*) AS n FROM nv)
    SELECT s AS id, round((count(*) - 1) / (n - 1) * (count(*) - 1) / sum(d), {DIGITS}) AS score FROM m4, n GROUP BY s, n""")
def k3_weighted_closeness(spark, sf_dir):
    return rounded(centrality.closeness_centrality(derived.nation_flow(spark, sf_dir), "weight"), "score")


@query(f"""WITH RECURSIVE {ALL_HOPS},
    short AS (SELECT h.s, h.t, h.seen FROM h JOIN hd ON hd.s = h.s AND hd.t = h.t AND hd.d = h.d),
    total AS (SELECT s, t, count(*) AS k FROM short GROUP BY s, t),
    through AS (SELECT s, t, unnest(seen) AS v FROM short)
    SELECT cv.id, round(coalesce(sum(1.0 / k) / 2, 0), {DIGITS}) AS score
    FROM cv LEFT JOIN (SELECT through.v, total.k FROM through JOIN total USING (s, t) WHERE v <> s AND v <> t) x ON x.v = cv.id GROUP BY cv.id""")
def k4_betweenness(spark, sf_dir, least=48):
    return rounded(centrality.betweenness_centrality(derived.copurchase_pairs(spark, sf_dir, least)), "score")


@query(f"""WITH {NATION_FLOW}, {doubled(4)},
    {", ".join([f"s{k} AS (" + ("SELECT id AS s, id AS t, CAST(1 AS DOUBLE) AS k FROM nv" if k == 0 else f"SELECT p.s, e.dst AS t, sum(p.k) AS k FROM s{k - 1} p JOIN m4 x ON x.s = p.s AND x.t = p.t JOIN ne e ON e.src = p.t JOIN m4 y ON y.s = p.s AND y.t = e.dst WHERE x.d + e.weight = y.d GROUP BY 1, 2") + ")" for k in range(0, 9)])},
    sigma AS (SELECT s, t, sum(k) AS k FROM ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(9))}) GROUP BY 1, 2)
    SELECT nv.id, round(coalesce(sum(x.k), 0), {DIGITS}) AS score FROM nv LEFT JOIN (
        SELECT a.t AS v, a.k * b.k / c.k AS k FROM sigma a JOIN sigma b ON b.s = a.t JOIN sigma c ON c.s = a.s AND c.t = b.t
        JOIN m4 ma ON ma.s = a.s AND ma.t = a.t JOIN m4 mb ON mb.s = b.s AND mb.t = b.t JOIN m4 mc ON mc.s = c.s AND mc.t = c.t
        WHERE a.s <> a.t AND b.s <> b.t AND a.s <> b.t AND ma.d + mb.d = mc.d
    ) x ON x.v = nv.id GROUP BY nv.id""")
def k5_weighted_betweenness(spark, sf_dir):
    return rounded(centrality.betweenness_centrality(derived.nation_flow(spark, sf_dir), "weight"), "score")


@query("WITH n AS (SELECT 8 * count(*) AS n FROM nation) SELECT v AS id, round(CAST(v * (n - 1 - v) AS DOUBLE), 8) AS score FROM n, LATERAL (SELECT unnest(range(n)) AS v)")
def k6_parallel_betweenness(spark, sf_dir):
    """Sources dealt over the tasks; on a path a vertex lies between all pairs of its two sides."""
    n = 8 * derived.table(spark, sf_dir, "nation").count()
    return rounded(centrality.betweenness_centrality(generate.path(spark, n)), "score")


def powers(step: str, first: str, rounds: int) -> str:
    parts = [f"x0 AS ({first})"]
    for k in range(1, rounds + 1):
        parts.append(f"x{k} AS ({step.replace('PREV', f'x{k - 1}')})")
    return ", ".join(parts)


RANK_STEP = """SELECT v.id, 0.15 / n + 0.85 * (SELECT coalesce(sum(x), 0) FROM PREV WHERE id NOT IN (SELECT src FROM o)) / n
    + 0.85 * coalesce((SELECT sum(p.x * e.w / o.k) FROM e JOIN o ON o.src = e.src JOIN PREV p ON p.id = e.src WHERE e.dst = v.id), 0) AS x FROM v, n"""
RANKED = f"n AS (SELECT count(*) AS n FROM v), o AS (SELECT src, sum(w) AS k FROM e GROUP BY src), {powers(RANK_STEP, 'SELECT id, CAST(1 AS DOUBLE) / n AS x FROM v, n', 8)}"


@query(f"""WITH {EVENT_FLOW}, v AS (SELECT src AS id FROM ee UNION SELECT dst FROM ee),
    e AS (SELECT src, dst, count(*) AS w FROM ee GROUP BY 1, 2), {RANKED} SELECT id, round(x, {DIGITS}) AS score FROM x8""")
def k7_pagerank(spark, sf_dir):
    return rounded(centrality.pagerank(derived.event_flow(spark, sf_dir), max_iterations=8, tolerance=0), "score")


@query(f"""WITH {CONV_CHAIN}, v AS (SELECT id FROM tt), e AS (SELECT src, dst, 1 AS w FROM te), {RANKED} SELECT id, round(x, {DIGITS}) AS score FROM x8""")
def k7_pagerank_dangling(spark, sf_dir):
    return rounded(centrality.pagerank(derived.conv_chain(spark, sf_dir), max_iterations=8, tolerance=0), "score")


EIGEN = """SELECT id, y / sqrt(sum(y * y) OVER ()) AS x FROM (
    SELECT v.id, p.x + coalesce((SELECT sum(q.x) FROM e JOIN PREV q ON q.id = e.src WHERE e.dst = v.id), 0) AS y FROM v JOIN PREV p ON p.id = v.id)"""


@query(f"""WITH {NATION_FLOW}, v AS (SELECT id FROM nv), e AS (SELECT src, dst FROM ne), n AS (SELECT count(*) AS n FROM v),
    {powers(EIGEN, "SELECT id, CAST(1 AS DOUBLE) / n AS x FROM v, n", 8)} SELECT id, round(x, {DIGITS}) AS score FROM x8""")
def k8_eigenvector(spark, sf_dir):
    return rounded(centrality.eigenvector_centrality(derived.nation_flow(spark, sf_dir), max_iterations=8, tolerance=0), "score")


KATZ = "SELECT v.id, 1.0 + 0.01 * coalesce((SELECT sum(q.x) FROM e JOIN PREV q ON q.id = e.src WHERE e.dst = v.id), 0) AS x FROM v"


@query(f"""WITH {NATION_FLOW}, v AS (SELECT id FROM nv), e AS (SELECT src, dst FROM ne),
    {powers(KATZ, "SELECT id, CAST(0 AS DOUBLE) AS x FROM v", 8)} SELECT id, round(x / sqrt(sum(x * x) OVER ()), {DIGITS}) AS score FROM x8""")
def k9_katz(spark, sf_dir):
    return rounded(centrality.katz_centrality(derived.nation_flow(spark, sf_dir), alpha=0.01, max_iterations=8, tolerance=0), "score")


# -- structure --------------------------------------------------------------------------------


@query(f"""WITH {NATION_FLOW}, {SUPP_PART}, n AS (SELECT count(*) AS n FROM (SELECT src FROM se UNION SELECT dst FROM se))
    SELECT round((SELECT count(*) FROM ne) / 600.0, {DIGITS}) AS nations, round(2.0 * (SELECT count(*) FROM se) / (n * (n - 1)), {DIGITS}) AS shipping FROM n""")
def s1_density(spark, sf_dir):
    a, b = derived.nation_flow(spark, sf_dir), derived.supp_part(spark, sf_dir)
    return row(spark, nations=round(structure.density(a), DIGITS), shipping=round(structure.density(b), DIGITS))


@query(f"WITH {HI} SELECT count(*) AS degree FROM ca GROUP BY src")
def s2_degree_sequence(spark, sf_dir, least=48):
    return structure.degree_sequence(derived.copurchase_pairs(spark, sf_dir, least))


@query(f"""WITH {SUPP_PART}, {NATION_FLOW} SELECT NOT EXISTS (SELECT 1 FROM se a JOIN se b ON a.dst = b.src) AS shipping,
    NOT EXISTS (SELECT 1 FROM ne a JOIN ne b ON a.dst = b.src JOIN ne c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.dst < b.dst) AS trade""")
def s3_is_bipartite(spark, sf_dir):
    nations = derived.nation_flow(spark, sf_dir)
    trade = PropertyGraph.from_dataframes(nations.edges.where("src < dst"), nations.vertices, directed=False)
    return row(spark, shipping=structure.is_bipartite(derived.supp_part(spark, sf_dir)), trade=structure.is_bipartite(trade))


@query(f"""WITH RECURSIVE {GEO_TREE}, w AS (
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 0 AS level FROM region
        UNION ALL SELECT ge.dst, level + 1 FROM w JOIN ge ON ge.src = w.id
    ) SELECT id, CASE WHEN level % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM w""")
def s4_bipartition(spark, sf_dir):
    return structure.find_bipartition(derived.geo_tree(spark, sf_dir))


@query(f"WITH {NATION_FLOW} SELECT dst AS src, src AS dst, weight FROM ne")
def s5_transpose(spark, sf_dir):
    return structure.transpose(derived.nation_flow(spark, sf_dir)).edges.select("src", "dst", "weight")


@query(f"""WITH RECURSIVE {part_seq_sql(46)}, pr AS (SELECT src, dst FROM pe UNION SELECT r.src, e.dst FROM pr r JOIN pe e ON e.src = r.dst)
    SELECT src, dst FROM pr""")
def s6_transitive_closure(spark, sf_dir):
    return structure.transitive_closure(derived.part_seq(spark, sf_dir, 46)).edges.select("src", "dst")


@query(f"WITH {GEO_TREE} SELECT src, dst FROM ge")
def s7_transitive_reduction(spark, sf_dir):
    g = derived.geo_tree(spark, sf_dir)
    return structure.transitive_reduction(structure.transitive_closure(g)).edges.select("src", "dst")


CLUSTER = f"""{MID},
k AS (SELECT src AS id, count(*) AS k FROM ca GROUP BY src),
l AS (
    SELECT a.src AS id, count(*) AS l FROM ca a JOIN ca b ON b.src = a.src AND a.dst < b.dst JOIN ce e ON e.src = a.dst AND e.dst = b.dst GROUP BY a.src
),
cf AS (SELECT k.id, k, coalesce(l, 0) AS l, CASE WHEN k > 1 THEN coalesce(l, 0) / (k * (k - 1) / 2) ELSE 0 END AS c FROM k LEFT JOIN l USING (id))"""


@query(f"WITH {CLUSTER} SELECT round(c, {DIGITS}) AS coefficient FROM cf ORDER BY c DESC, id LIMIT 1")
def s8_local_clustering(spark, sf_dir, least=45):
    g = derived.copurchase_pairs(spark, sf_dir, least)
    best = structure.clustering_coefficients(g).orderBy(F.desc("coefficient"), "id").first()["id"]
    found = round(float(structure.local_clustering_coefficient(g, best)), DIGITS)
    discard(g.edges)
    return row(spark, coefficient=found)


@query(f"WITH {CLUSTER} SELECT id, round(c, {DIGITS}) AS coefficient FROM cf")
def s9_clustering(spark, sf_dir, least=45):
    g = derived.copurchase_pairs(spark, sf_dir, least)
    found = cut(rounded(structure.clustering_coefficients(g), "coefficient"))
    discard(g.edges)
    return found


@query(f"WITH {CLUSTER} SELECT round(avg(c), {DIGITS}) AS average FROM cf")
def s10_average_clustering(spark, sf_dir, least=45):
    return row(spark, average=round(structure.average_clustering_coefficient(derived.copurchase_pairs(spark, sf_dir, least)), DIGITS))


@query(f"WITH {CLUSTER} SELECT round(sum(l) / sum(k * (k - 1) / 2), {DIGITS}) AS ratio FROM cf")
def s11_global_clustering(spark, sf_dir, least=45):
    return row(spark, ratio=round(structure.global_clustering_coefficient(derived.copurchase_pairs(spark, sf_dir, least)), DIGITS))


@query(f"""WITH RECURSIVE {HI}, q AS (
        SELECT [id] AS c FROM cv
        UNION ALL SELECT list_append(q.c, v.id) FROM q JOIN cv v ON v.id > q.c[-1]
        WHERE (SELECT count(*) FROM ca WHERE ca.src = v.id AND list_contains(q.c, ca.dst)) = len(q.c)
    ) SELECT array_to_string(c, ',') AS clique FROM q
    WHERE NOT EXISTS (SELECT 1 FROM ca a WHERE list_contains(q.c, a.src) AND NOT list_contains(q.c, a.dst) GROUP BY a.dst HAVING count(*) = len(q.c))""")
def s12_maximal_cliques(spark, sf_dir, least=48):
    return structure.maximal_cliques(derived.copurchase_pairs(spark, sf_dir, least)).select(F.concat_ws(",", F.col("clique").cast("array<string>")).alias("clique"))


@query(f"WITH {HI} SELECT (SELECT count(*) FROM cv) AS colored, CAST(0 AS BIGINT) AS conflicts")
def s13_color(spark, sf_dir, least=48):
    g = derived.copurchase_pairs(spark, sf_dir, least)
    c = cut(structure.color_vertices(g))
    both = g.edges.join(c.withColumnsRenamed({"id": "src", "color": "a"}), "src").join(c.withColumnsRenamed({"id": "dst", "color": "b"}), "dst")
    return row(spark, colored=c.count(), conflicts=both.where("a = b").count())


# -- graphs from graphs -----------------------------------------------------------------------


@query(f"WITH {NATION_FLOW} SELECT src, dst, weight FROM ne WHERE src < 10 AND dst < 10")
def o1_subgraph(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    return setops.subgraph(g, g.vertices.where("id < 10").select("id")).edges.select("src", "dst", "weight")


@query(f"""WITH {HI}, {copurchase_sql(45).replace("cl AS", "dl AS").replace("ce AS", "de AS").replace("FROM cl a JOIN cl b", "FROM dl a JOIN dl b").split("cv AS")[0].rstrip().rstrip(",")}
    SELECT src, dst, weight FROM ce UNION ALL SELECT src, dst, weight FROM de WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.src = de.src AND ce.dst = de.dst)""")
def o2_union(spark, sf_dir, least=45):
    a, b = derived.copurchase_pairs(spark, sf_dir, 48), derived.copurchase_pairs(spark, sf_dir, least)
    return setops.union(a, b).edges.select("src", "dst", "weight")


@query(f"""WITH {NATION_FLOW}, busy AS (SELECT * FROM ne WHERE weight >= (SELECT avg(weight) FROM ne))
    SELECT a.id AS src, b.id AS dst FROM nv a JOIN nv b ON a.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM busy WHERE src = a.id AND dst = b.id)""")
def o3_complement(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    mean = g.edges.agg(F.avg("weight")).first()[0]
    return setops.complement(g.with_edges(g.edges.where(F.col("weight") >= mean))).edges.select("src", "dst")


# -- trees, flows, matchings, trails ----------------------------------------------------------


@query(f"""WITH RECURSIVE {HI}, ranked AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight, src, dst) AS r FROM ce),
    mr AS (
        SELECT r, src AS pos FROM ranked
        UNION SELECT m.r, CASE WHEN e.src = m.pos THEN e.dst ELSE e.src END FROM mr m JOIN ranked e ON e.r < m.r AND (e.src = m.pos OR e.dst = m.pos)
    ) SELECT src, dst, weight FROM ranked WHERE NOT EXISTS (SELECT 1 FROM mr WHERE mr.r = ranked.r AND mr.pos = ranked.dst)""")
def x1_kruskal(spark, sf_dir, least=48):
    return spanning.Kruskal().find(derived.copurchase_pairs(spark, sf_dir, least)).select("src", "dst", "weight")


KRUSKAL_HI = f"""{HI}, ranked AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight, src, dst) AS r FROM ce),
    mr AS (
        SELECT r, src AS pos FROM ranked
        UNION SELECT m.r, CASE WHEN e.src = m.pos THEN e.dst ELSE e.src END FROM mr m JOIN ranked e ON e.r < m.r AND (e.src = m.pos OR e.dst = m.pos)
    ), forest AS (SELECT src, dst, weight FROM ranked WHERE NOT EXISTS (SELECT 1 FROM mr WHERE mr.r = ranked.r AND mr.pos = ranked.dst))"""


@query(f"WITH RECURSIVE {KRUSKAL_HI} SELECT count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight, CAST(0 AS BIGINT) AS apart FROM forest")
def x2_prim(spark, sf_dir, least=48):
    g = derived.copurchase_pairs(spark, sf_dir, least)
    grown = cut(spanning.Prim().find(g))
    # every edge but a tree's first has an end at an earlier one
    ends = grown.select("tree", "step", F.explode(F.array("src", "dst")).alias("v"))
    joined = ends.alias("a").join(ends.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.v") == F.col("b.v")) & (F.col("b.step") < F.col("a.step")))
    apart = grown.where("step > 0").count() - joined.select("a.tree", "a.step").distinct().count()
    total = grown.agg(F.sum("weight")).first()[0]
    return row(spark, edges=grown.count(), weight=total, apart=apart)


@query(f"WITH RECURSIVE {KRUSKAL_HI} SELECT src, dst, weight FROM forest")
def x3_spanning_forest(spark, sf_dir, least=48):
    return spanning.minimum_spanning_forest(derived.copurchase_pairs(spark, sf_dir, least)).select("src", "dst", "weight")


def _flow_row(spark, found) -> DataFrame:
    cut_value = found.min_cut_edges.agg(F.sum("capacity")).first()[0] or 0
    return row(spark, flow_value=found.flow_value, cut_value=cut_value, is_cut=found.source_side.where("id = 4").isEmpty())


# every nation trades with every other, so the least cut is around one end or takes more; all 2^k sides are too many, the flow is checked by its own cut
CUT_IS_FLOW = f"""WITH {NATION_FLOW}, s AS (SELECT sum(weight) AS w FROM ne WHERE src = 1 AND dst <> 1), t AS (SELECT sum(weight) AS w FROM ne WHERE dst = 4 AND src <> 4)
    SELECT CAST(least(s.w, t.w) AS BIGINT) AS flow_value, CAST(least(s.w, t.w) AS BIGINT) AS cut_value, true AS is_cut FROM s, t"""


@query(CUT_IS_FLOW)
def x4_edmonds_karp(spark, sf_dir):
    return _flow_row(spark, flow.EdmondsKarp().find(derived.nation_flow(spark, sf_dir), 1, 4))


@query(CUT_IS_FLOW)
def x5_dinic(spark, sf_dir):
    return _flow_row(spark, flow.Dinic().find(derived.nation_flow(spark, sf_dir), 1, 4))


@query(CUT_IS_FLOW.replace("SELECT CAST(least", "SELECT 'EdmondsKarp' AS algorithm, CAST(least") + " UNION ALL " + "SELECT 'Dinic', CAST(least(s.w, t.w) AS BIGINT), CAST(least(s.w, t.w) AS BIGINT), true FROM s, t")
def x6_maximum_flow(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    facade, dinic = flow.maximum_flow(g, 1, 4), flow.Dinic().find(g, 1, 4)
    named = lambda name, found: _flow_row(spark, found).withColumn("algorithm", F.lit(name))
    return named("EdmondsKarp", facade).unionByName(named("Dinic", dinic))


def refused(call, *errors) -> bool:
    try:
        call()
    except errors:
        return True
    return False


@query(f"""WITH {NATION_FLOW} SELECT id, NOT EXISTS (SELECT 1 FROM ne WHERE src = nv.id) AS isolated, id = 4 AS same, true AS undirected, true AS negative, true AS unknown FROM nv WHERE id = 4""")
def x8_flow_guards(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    turned = g.with_edges(g.edges.withColumn("weight", -F.col("weight")))
    return row(
        spark, id=4, isolated=g.out_edges(4).isEmpty(),
        same=refused(lambda: flow.maximum_flow(g, 4, 4), ValueError),
        undirected=refused(lambda: flow.maximum_flow(PropertyGraph(g.vertices, g.edges, False, False), 1, 4), ValueError),
        negative=refused(lambda: flow.maximum_flow(turned, 1, 4), NegativeWeightError),
        unknown=refused(lambda: flow.maximum_flow(g, 1, 4_000), ValueError),
    )


@query(f"WITH {NATION_FLOW} SELECT (SELECT count(*) FROM ne WHERE src <> dst) AS edges, CAST(0 AS BIGINT) AS unbalanced, CAST(0 AS BIGINT) AS overfull")
def x7_flow_conservation(spark, sf_dir):
    g = derived.nation_flow(spark, sf_dir)
    found = flow.maximum_flow(g, 1, 4)
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("flow").alias("f")), F.struct(F.col("dst").alias("id"), (-F.col("flow")).alias("f"))))
    net = found.edge_flows.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.f").alias("f")).where("f <> 0 and id not in (1, 4)")
    over = found.edge_flows.join(g.edges.select("eid", "weight"), "eid").where("flow > weight or flow < 0")
    return row(spark, edges=found.edge_flows.count(), unbalanced=net.count(), overfull=over.count())


@query(f"WITH {SUPP_PART} SELECT count(DISTINCT src) AS size, CAST(0 AS BIGINT) AS clashes FROM se")
def x9_matching(spark, sf_dir):
    chosen = cut(matching.maximum_bipartite_matching(derived.supp_part(spark, sf_dir)))
    ends = chosen.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count().where("count > 1")
    return row(spark, size=chosen.count(), clashes=ends.count())


@query(f"""WITH {EVENT_FLOW}, d AS (SELECT id, sum(x) AS x FROM (SELECT src AS id, 1 AS x FROM ee UNION ALL SELECT dst, -1 FROM ee) GROUP BY id)
    SELECT bool_and(x = 0) AS circuit, count(*) FILTER (WHERE x <> 0) = 0 OR (count(*) FILTER (WHERE x <> 0) = 2 AND max(abs(x)) = 1) AS path FROM d""")
def x10_has_euler(spark, sf_dir):
    g = derived.event_flow(spark, sf_dir)
    return row(spark, circuit=euler.has_eulerian_circuit(g), path=euler.has_eulerian_path(g))


@query(f"WITH {EVENT_FLOW} SELECT 2 * count(*) AS edges, 2 * count(*) AS distinct_edges, CAST(0 AS BIGINT) AS breaks FROM ee")
def x11_euler_circuit(spark, sf_dir):
    g = derived.event_flow(spark, sf_dir)
    # every edge and its reverse: balanced everywhere
    last = g.edges.agg(F.max("ord")).first()[0] + 1
    back = g.edges.withColumns({"src": F.col("dst"), "dst": F.col("src"), "ord": F.col("ord") + last, "eid": F.col("eid") + last})
    trail = cut(euler.find_eulerian_circuit(g.with_edges(g.edges.unionByName(back))))
    n = trail.count()
    follow = trail.select(((F.col("pos") + 1) % n).alias("pos"), F.col("to_id").alias("before"))
    breaks = trail.join(follow, "pos").where("from_id <> before").count()
    return row(spark, edges=n, distinct_edges=trail.select("eid").distinct().count(), breaks=breaks)


@query("WITH n AS (SELECT count(*) AS n FROM nation) SELECT CAST(k AS BIGINT) AS pos, CAST(k AS BIGINT) AS from_id, CAST(k + 1 AS BIGINT) AS to_id FROM n, LATERAL (SELECT unnest(range(n - 1)) AS k)")
def x11_euler_path(spark, sf_dir):
    """A graph with a path and no circuit has that path's trail from one end to the other."""
    g = generate.path(spark, derived.table(spark, sf_dir, "nation").count())
    if euler.find_eulerian_circuit(g) is not None:
        raise AssertionError("a path has no circuit")
    return euler.find_eulerian_path(g).select("pos", "from_id", "to_id")


# -- hypergraphs ------------------------------------------------------------------------------

ORDER_PARTS = "hp AS (SELECT DISTINCT l_orderkey AS hid, l_partkey AS v FROM lineitem)"
REMOVED = "hr AS (SELECT * FROM hp WHERE hid NOT IN (SELECT hid FROM hp WHERE v = (SELECT min(v) FROM hp)))"


@query(f"WITH {ORDER_PARTS} SELECT count(*) + 2 AS incidences, count(DISTINCT hid) + 1 AS hyperedges, count(DISTINCT v) AS vertices FROM hp")
def h1_add_hyperedge(spark, sf_dir):
    g = derived.copurchase(spark, sf_dir)
    two = [r["id"] for r in g.vertices.orderBy("id").limit(2).collect()]
    g, _ = g.add_hyperedge([two[0], two[1], two[0]])
    return row(spark, incidences=g.incidence.count(), hyperedges=g.hyperedge_count(), vertices=g.vertex_count())


@query(f"WITH {ORDER_PARTS}, {REMOVED} SELECT hid, v FROM hr")
def h2_remove_vertex(spark, sf_dir):
    g = derived.copurchase(spark, sf_dir)
    return g.remove_vertex(g.vertices.agg(F.min("id")).first()[0]).incidence


@query(f"WITH {ORDER_PARTS} SELECT v AS id, count(*) AS degree FROM hp GROUP BY v")
def h3_hyper_degrees(spark, sf_dir):
    return derived.copurchase(spark, sf_dir).degrees()


@query(f"WITH RECURSIVE {REACH_HI} SELECT id, component FROM cc")
def h5_hyper_components(spark, sf_dir, least=48):
    line = derived.lines(spark, sf_dir, least).select(F.col("l_orderkey").alias("hid"), F.col("l_partkey").alias("v"))
    shared = line.distinct().groupBy("hid").count().where("count > 1").select("hid")
    return Hypergraph.from_dataframe(line.join(shared, "hid")).connected_components()


@query(f"""WITH RECURSIVE {ORDER_PARTS}, k AS (SELECT min(v) AS a, max(v) AS b FROM hp),
    r AS (SELECT a AS v FROM k UNION SELECT y.v FROM r JOIN hp x ON x.v = r.v JOIN hp y ON y.hid = x.hid)
    SELECT EXISTS (SELECT 1 FROM r, k WHERE r.v = k.b) AS connected""")
def h4_are_connected(spark, sf_dir):
    g = derived.copurchase(spark, sf_dir)
    ends = g.vertices.agg(F.min("id"), F.max("id")).first()
    return row(spark, connected=g.are_connected(*ends))


@query(f"WITH {ORDER_PARTS} SELECT DISTINCT a.v AS src, b.v AS dst FROM hp a JOIN hp b ON a.hid = b.hid AND a.v < b.v")
def h6_clique_expansion(spark, sf_dir):
    return derived.copurchase(spark, sf_dir).to_clique_expansion().edges.select("src", "dst")


@query(f"WITH {ORDER_PARTS}, n AS (SELECT hid, dense_rank() OVER (ORDER BY hid) - 1 AS i FROM (SELECT DISTINCT hid FROM hp)) SELECT v AS vertex, CAST(i AS INTEGER) AS hyperedge_index FROM hp JOIN n USING (hid)")
def h7_incidence_graph(spark, sf_dir):
    e = derived.copurchase(spark, sf_dir).to_incidence_graph().edges
    return e.select(F.col("src.vertex").alias("vertex"), F.col("dst.hyperedge_index").alias("hyperedge_index"))


# -- generators -------------------------------------------------------------------------------


@query("SELECT true AS within, CAST(0 AS BIGINT) AS loops")
def r1_erdos_renyi(spark, sf_dir):
    g = generate.erdos_renyi(spark, 400, 0.1, 42)
    return row(spark, within=abs(g.edge_count() - 7980) < 500, loops=g.edges.where("src = dst").count())


@query("""SELECT 'complete' AS kind, CAST(a.range AS BIGINT) AS src, CAST(b.range AS BIGINT) AS dst FROM range(6) a, range(6) b WHERE a.range < b.range
    UNION ALL SELECT 'bipartite', a.range, 3 + b.range FROM range(3) a, range(4) b
    UNION ALL SELECT 'path', range, range + 1 FROM range(4) UNION ALL SELECT 'cycle', range, (range + 1) % 5 FROM range(5)
    UNION ALL SELECT 'star', 0, range + 1 FROM range(4)
    UNION ALL SELECT 'grid', range, range + 1 FROM range(12) WHERE range % 4 < 3 UNION ALL SELECT 'grid', range, range + 4 FROM range(12) WHERE range < 8""")
def r2_closed_forms(spark, sf_dir):
    made = {
        "complete": generate.complete(spark, 6), "bipartite": generate.complete_bipartite(spark, 3, 4), "path": generate.path(spark, 5),
        "cycle": generate.cycle(spark, 5), "star": generate.star(spark, 4), "grid": generate.grid(spark, 4, 3),
    }
    parts = [g.edges.select(F.lit(k).alias("kind"), "src", "dst") for k, g in made.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT CAST(3 * (200 - 3) AS BIGINT) AS edges, true AS connected")
def r3_barabasi_albert(spark, sf_dir):
    g = generate.barabasi_albert(spark, 200, 3, 7).freeze()
    return row(spark, edges=g.edge_count(), connected=connectivity.is_connected(g))


@query("SELECT CAST(200 * 4 / 2 AS BIGINT) AS edges, CAST(200 * 4 / 2 AS BIGINT) AS pairs")
def r4_watts_strogatz(spark, sf_dir):
    g = generate.watts_strogatz(spark, 200, 4, 0.2, 7).freeze()
    return row(spark, edges=g.edge_count(), pairs=g.skeleton().count())


# -- text formats -----------------------------------------------------------------------------


@query(f"""WITH {NATION_FLOW} SELECT 'digraph "nations" {{' AS line UNION ALL SELECT '    "' || id || '";' FROM nv
    UNION ALL SELECT '    "' || src || '" -> "' || dst || '" [label="' || weight || '"];' FROM ne UNION ALL SELECT '}}'""")
def z1_dot(spark, sf_dir):
    return text_formats.to_dot(derived.nation_flow(spark, sf_dir), "nations", edge_label=F.col("weight")).select("line")


@query(f"""WITH {NATION_FLOW} SELECT 'flowchart LR' AS line UNION ALL SELECT '    v' || id || '["' || id || '"]' FROM nv
    UNION ALL SELECT '    v' || src || ' -->|"' || weight || '"| v' || dst FROM ne""")
def z2_mermaid(spark, sf_dir):
    return text_formats.to_mermaid(derived.nation_flow(spark, sf_dir), "LR", edge_label=F.col("weight")).select("line")


@query(f"""WITH {NATION_FLOW} SELECT '    <edge source="' || src || '" target="' || dst || '">' || chr(10) || '      <data key="weight">' || weight || '.0</data>' || chr(10) || '    </edge>' AS line FROM ne""")
def z3_graphml(spark, sf_dir):
    return text_formats.to_graphml(derived.nation_flow(spark, sf_dir), weight="weight").where("section = 3").select("line")


@query(f"WITH {NATION_FLOW} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(weight AS DOUBLE) AS weight FROM ne")
def z4_parse_graphml(spark, sf_dir):
    text = text_formats.text(text_formats.to_graphml(derived.nation_flow(spark, sf_dir), weight="weight"))
    return documents.parse_graphml(spark, text, True, "weight").edges.select("src", "dst", "weight")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS INTEGER) AS region FROM nation")
def z5_parse_graphml_document(spark, sf_dir):
    n = derived.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    g = PropertyGraph(n, derived.nation_flow(spark, sf_dir).edges)
    doc = documents.parse_graphml_document(spark, text_formats.text(text_formats.to_graphml(g, vertex_attributes=["name", "region"])))
    return doc.vertex_data.select("id", doc.attribute("name").alias("name"), doc.attribute("region", "int").alias("region"))


@query(f"WITH {NATION_FLOW} SELECT CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS target, CAST(weight AS DOUBLE) AS weight, (SELECT count(*) FROM nv) AS nodes FROM ne")
def z6_node_link(spark, sf_dir):
    """What a plain JSON reader finds in the document."""
    doc = json.loads(text_formats.text(text_formats.to_node_link(derived.nation_flow(spark, sf_dir), weight="weight")))
    ids = {str(n["id"]) for n in doc["nodes"]}
    rows = [(str(e["source"]), str(e["target"]), float(e["weight"]), len(ids)) for e in doc["edges"]]
    return spark.createDataFrame(rows, "source string, target string, weight double, nodes long")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(2 * n_regionkey AS BIGINT) AS twice, length(n_name) AS letters FROM nation")
def z9_typed_attributes(spark, sf_dir):
    n = derived.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    g = PropertyGraph(n, derived.nation_flow(spark, sf_dir).edges)
    doc = documents.parse_graphml_document(spark, text_formats.text(text_formats.to_graphml(g, vertex_attributes=["name", "region"])))
    twice = (2 * doc.attribute("region", "int")).cast("long").alias("twice")
    return doc.vertex_data.select("id", twice, F.length(doc.attribute("name")).cast("long").alias("letters"))


@query(f"WITH {NATION_FLOW} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(weight AS DOUBLE) AS weight FROM ne")
def z7_parse_node_link(spark, sf_dir):
    text = text_formats.text(text_formats.to_node_link(derived.nation_flow(spark, sf_dir), weight="weight"))
    return documents.parse_node_link(spark, text, True, "weight").edges.select("src", "dst", "weight")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def z8_parse_node_link_document(spark, sf_dir):
    n = derived.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    g = PropertyGraph(n, derived.nation_flow(spark, sf_dir).edges)
    doc = documents.parse_node_link_document(spark, text_formats.text(text_formats.to_node_link(g, vertex_attributes=["name", "region"])))
    return doc.vertex_data.select("id", doc.attribute("name").alias("name"), doc.attribute("region", "double").alias("region"))


# -- whole graphs -----------------------------------------------------------------------------

#: The queries above whose SQL keeps large quantities only, over all lines; they have no SQL.
WHOLE = [
    "c4_contains_edges", "c10_add_vertices", "t4_has_cycle", "n1_connected_components", "n2_is_connected", "n4_strong_components", "n5_bridges",
    "n6_articulation_points", "n7_condense", "s2_degree_sequence", "s8_local_clustering", "s9_clustering", "s10_average_clustering",
    "s11_global_clustering", "s12_maximal_cliques", "s13_color", "o2_union", "x1_kruskal", "x2_prim", "h5_hyper_components",
]
#: A traversal from each vertex: over the large component of lines of at least 45, as the survey assigns.
MIDDLE = ["m1_eccentricities", "m2_diameter", "m3_radius", "m4_center", "m5_periphery", "m6_average_path_length", "k2_closeness", "k4_betweenness"]
QUERIES |= {f"{name}_whole": partial(QUERIES[name], least=None) for name in WHOLE}
QUERIES |= {f"{name}_mid": partial(QUERIES[name], least=45) for name in MIDDLE}
