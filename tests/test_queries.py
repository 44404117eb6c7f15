"""Some of the registered queries against their SQL, and the entry module's contract."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Every nation trades with every other only from this size on.
DENSE = {"x6_maximum_flow": "/root/testdata/sf0.01", "p1_strategies": "/root/testdata/sf0.01"}
CHECKED = ["c4_contains_edges", "c6_degrees", "o3_complement", "n1_connected_components", "s9_clustering", "x1_kruskal", "x2_prim", "x3_spanning_forest", "x8_flow_guards", "x11_euler_path", "p5_a_star", "p9_result", "k6_parallel_betweenness", "s3_is_bipartite", "z9_typed_attributes", "h4_are_connected", "h6_clique_expansion", "p6_floyd_warshall", "t6_topological_order", "z1_dot", "z6_node_link"]


def norm(rows):
    return sorted(tuple(str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", [*CHECKED, *DENSE])
def test_query_matches_its_sql(spark, name):
    con, sf_dir = duckdb.connect(), DENSE.get(name, SF)
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in found.description]
    rows = [[r[order.index(n)] for n in names] for r in found.fetchall()]
    assert sorted(order) == names
    assert norm(df.select(*names).collect()) == norm(rows)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 25 and sum(r["score"] for r in rows) == pytest.approx(1)


def test_registries(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
