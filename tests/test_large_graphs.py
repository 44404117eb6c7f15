"""The forms that large graphs take, on small ones."""

import os
import time
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from helpers import column, graph, random_edges, table
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.functions import blocks, forests
from graphloom.operators import connectivity, euler, kernels, matching, structure, traversal
from graphloom.plans import lineage
from graphloom.sources import derived


def simple(seed, n, m):
    """Distinct edges, among them a hub's and those of a clique."""
    edges = {(min(e), max(e)) for e in random_edges(seed, n, m, False)} | {(0, v) for v in range(1, n)} | set(combinations(range(5, 14), 2))
    return sorted(e for e in edges if e[0] != e[1])


def clustering(edges):
    """(links, possible) of each vertex."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {v: (sum(b in near[a] for a, b in combinations(sorted(n), 2)), len(n) * (len(n) - 1) / 2) for v, n in near.items()}


@pytest.fixture
def in_blocks(monkeypatch):
    """Every graph is large; a join of edge pairs fails."""
    monkeypatch.setattr(structure, "BLOCKED", 0)
    monkeypatch.setattr(blocks, "BLOCK_ENDS", 40)
    monkeypatch.setattr(structure, "triangles", lambda g: pytest.fail("edge pairs are joined"))


def test_global_clustering_without_edge_pairs(spark, in_blocks):
    edges = simple(3, 150, 700)
    found = clustering(edges)
    expected = sum(l for l, _ in found.values()) / sum(p for _, p in found.values())
    assert structure.global_clustering_coefficient(graph(spark, edges)) == pytest.approx(expected)
    assert structure.global_clustering_coefficient(graph(spark, [(1, 2)])) == 0


def test_average_clustering_without_edge_pairs(spark, in_blocks):
    edges = simple(4, 100, 400)
    found = [l / p if p else 0 for l, p in clustering(edges).values()]
    assert structure.average_clustering_coefficient(graph(spark, edges, [999])) == pytest.approx(sum(found) / (len(found) + 1))


def test_local_clustering_without_edge_pairs(spark, in_blocks, monkeypatch):
    edges = simple(5, 60, 200)
    found = {v: l / p if p else 0 for v, (l, p) in clustering(edges).items()}
    g = graph(spark, edges)
    best = structure.clustering_coefficients(g).orderBy("coefficient", "id").first()["id"]
    assert best == min(found, key=lambda v: (found[v], v))
    for near in (0, 100_000):
        monkeypatch.setattr(structure, "NEAR", near)
        assert structure.local_clustering_coefficient(g, 0) == pytest.approx(found[0])


def test_clustering_without_edge_pairs(spark, in_blocks):
    edges = simple(6, 120, 500)
    shifted = [((a << 33) - 7, (b << 33) - 7) for a, b in edges]
    found = {(v << 33) - 7: l / p if p else 0 for v, (l, p) in clustering(edges).items()}
    assert table(structure.clustering_coefficients(graph(spark, shifted))) == pytest.approx(found)


def removed(vertices, edges):
    """Components of the vertices by the edges."""
    label = {v: v for v in vertices}
    for _ in vertices:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return len(set(label.values()))


@pytest.mark.parametrize("kind", [int, str])
def test_bridges_beyond_a_kernel(spark, monkeypatch, kind):
    monkeypatch.setattr(kernels, "by_component", lambda *a, **k: pytest.fail("all edges go to a kernel"))
    edges = [e for e in random_edges(12, 24, 30, False) if e[0] != e[1]] + [(30, 31), (30, 31), (31, 32)]
    vertices = sorted({v for e in edges for v in e})
    whole = removed(vertices, edges)
    expected = [k for k in range(len(edges)) if removed(vertices, edges[:k] + edges[k + 1 :]) > whole]
    g = graph(spark, [(kind(a), kind(b)) for a, b in edges], multi=True)
    assert sorted(column(connectivity.find_bridges(g), "eid")) == expected and expected


@pytest.mark.parametrize("kind", [int, str])
def test_articulation_points_beyond_a_kernel(spark, monkeypatch, kind):
    monkeypatch.setattr(kernels, "by_component", lambda *a, **k: pytest.fail("all edges go to a kernel"))
    edges = [e for e in random_edges(13, 24, 32, False) if e[0] != e[1]] + [(30, 31), (30, 31), (31, 32)]
    vertices = sorted({v for e in edges for v in e})
    whole = removed(vertices, edges)
    expected = []
    for v in vertices:
        rest = [e for e in edges if v not in e]
        if removed([x for x in vertices if x != v], rest) > whole:
            expected.append(kind(v))
    g = graph(spark, [(kind(a), kind(b)) for a, b in edges], multi=True)
    assert sorted(column(connectivity.find_articulation_points(g))) == sorted(expected) and expected


def test_certificate_holds_few_bytes_an_edge():
    r = np.random.default_rng(14)
    a = r.integers(0, 30_000, 120_000)
    b = (a + r.integers(1, 29_999, len(a))) % 30_000
    eid, found = np.arange(len(a)), []
    for apart in (1, 1 << 40):
        tracemalloc.start()
        kept = forests.certified(a * apart, b * apart, eid)
        points = forests._low_links(*kept)[1] // apart
        # 48 bytes an edge are its own, in the two columns made here and what is kept
        found.append((tracemalloc.get_traced_memory()[1] / len(a), kept[2].tolist(), points.tolist()))
        tracemalloc.stop()
    assert found[0][1:] == found[1][1:] and len(found[0][1]) < 2 * 30_000
    assert max(f[0] for f in found) < 100


def test_cycle_of_more_arcs_than_a_kernel_takes(spark, monkeypatch):
    inside = kernels.single
    monkeypatch.setattr(kernels, "single", lambda df, kernel, schema: inside(df, kernel, schema, 12))
    for edges in (random_edges(31, 40, 160, False), [(k, (k + 1) % 9) for k in range(9)] + [(k, 0) for k in range(9, 60)] + [(k, k - 1) for k in range(60, 99)]):
        found = traversal.find_cycle(graph(spark, edges, [], True, True))
        assert len(set(found)) == len(found) and set(zip(found, found[1:] + found[:1])) <= set(edges)
    assert traversal.find_cycle(graph(spark, [(k, k + 1 + k % 2) for k in range(40)], [], True)) is None


@pytest.mark.parametrize("directed", [True, False])
def test_trail_of_more_edges_than_a_kernel_takes(spark, monkeypatch, directed):
    monkeypatch.setattr(euler, "PIECED", 10)
    monkeypatch.setattr(euler, "AT_ONCE", 40)
    inside = kernels.single
    monkeypatch.setattr(kernels, "single", lambda df, kernel, schema: inside(df, kernel, schema, 150))
    edges = random_edges(41, 7, 120, False)
    edges = edges + [(b, a) for a, b in edges]
    g = graph(spark, edges, [], directed, True)
    rows = sorted(euler.find_eulerian_circuit(g).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(240)) and {r.eid for r in rows} == set(range(240))
    assert all(a.to_id == b.from_id for a, b in zip(rows, rows[1:] + rows[:1]))
    for r in rows:
        assert (r.from_id, r.to_id) == edges[r.eid] or (not directed and (r.to_id, r.from_id) == edges[r.eid])


def test_bipartition_of_parts(spark, monkeypatch):
    monkeypatch.setattr(connectivity, "component_ords", lambda *a: pytest.fail("rounds over all edges"))
    edges = [(2 * a, 2 * b + 1) for a, b in random_edges(51, 30, 70, False)] + [(100, 101), (102, 101)]
    sides = table(structure.find_bipartition(graph(spark, edges, [500])))
    assert all(sides[a] != sides[b] for a, b in edges) and sides[500] == sides[100] == sides[102] == "left"
    assert structure.find_bipartition(graph(spark, [*edges, (100, 102)])) is None


def test_matching_of_more_edges_than_a_kernel_takes(spark, monkeypatch):
    monkeypatch.setattr(matching, "PACKED", 5)
    monkeypatch.setattr(kernels, "by_component", lambda *a, **k: pytest.fail("all edges go to a kernel"))
    for seed in (61, 62):
        edges = sorted({(f"a{a}", f"b{b % 11}") for a, b in random_edges(seed, 14, 40, False)})
        chosen = ends = [(r.src, r.dst) for r in matching.maximum_bipartite_matching(graph(spark, edges)).collect()]
        assert set(chosen) <= set(edges) and len({v for e in ends for v in e}) == 2 * len(ends)
        mate = {}

        def grow(a, seen):
            for x, b in edges:
                if x == a and b not in seen:
                    seen.add(b)
                    if b not in mate or grow(mate[b], seen):
                        mate[b] = a
                        return True
            return False

        assert len(chosen) == sum(grow(a, set()) for a in sorted({a for a, _ in edges}))


def test_colours_of_more_edges_than_a_kernel_takes(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ENDS", 60)
    dense = list(combinations(range(200, 270), 2))  # more colours than a word has bits
    for edges in (simple(71, 90, 300), dense + [(1, 200), (1, 2)], [(f"v{a}", f"v{b}") for a, b in simple(72, 40, 100)]):
        isolated = ["alone"] if isinstance(edges[0][0], str) else [999]
        g = graph(spark, edges, isolated)
        monkeypatch.setattr(structure, "BLOCKED", 1_000_000)
        small = table(structure.color_vertices(g))
        monkeypatch.setattr(structure, "BLOCKED", 0)
        with monkeypatch.context() as large:
            large.setattr(kernels, "by_component", lambda *a, **k: pytest.fail("all edges go to a kernel"))
            assert table(structure.color_vertices(g)) == small


def test_cliques_without_edge_pairs(spark, monkeypatch):
    edges = simple(81, 40, 120)
    g = graph(spark, edges, [999])
    small = sorted(column(structure.maximal_cliques(g), "clique"))
    monkeypatch.setattr(structure, "BLOCKED", 0)
    monkeypatch.setattr(blocks, "BLOCK_ENDS", 40)
    seen, inside = [], blocks.Blocks.triangles
    monkeypatch.setattr(blocks.Blocks, "triangles", lambda self, *a: seen.append(1) or inside(self, *a))
    assert sorted(column(structure.maximal_cliques(g), "clique")) == small and seen


def shuffled(spark, least=0):
    """Names of the shuffle files of at least so many bytes that are there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f and f.endswith(".data") and os.path.exists(f) and os.path.getsize(f) >= least}


def none_left(spark, before, least=0):
    """Whether the later shuffle files go within ten seconds."""
    for _ in range(100):
        if not shuffled(spark, least) - before:
            return True
        time.sleep(0.1)
    return False


def test_stored_tables_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(lineage, "release", lambda spark: None)
    before = shuffled(spark)
    kept = lineage.store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert none_left(spark, before)
    assert table(kept.withColumnRenamed("k", "id")) == {k: len(range(k, 1000, 7)) for k in range(7)}


def test_average_clustering_leaves_no_shuffle_files(spark, in_blocks):
    edges = simple(7, 90, 300)
    g = graph(spark, edges).freeze()
    before = shuffled(spark)
    links = structure._links(g)
    assert none_left(spark, before)
    assert {r["id"]: (r["links"], r["k"] * (r["k"] - 1) / 2) for r in links.collect()} == clustering(edges)


def test_edges_of_great_ids_are_stored(spark, tmp_path, monkeypatch):
    """The order of ids above 2^29 is kept in compressed columns too, not in a checkpoint of every edge."""
    inside, sizes = lineage.cut, []
    monkeypatch.setattr(derived, "cut", lambda df: sizes.append(df.count()) or inside(df))
    lines = [(o, (p + 1) << 40) for o in range(20) for p in range(o % 5, o % 5 + 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    g = derived.copurchase_pairs(spark, str(tmp_path), None)
    pairs = sorted({(a, b) for o, a in lines for q, b in lines if o == q and a < b})
    assert [(r.src, r.dst) for r in g.edges.orderBy("ord").collect()] == pairs
    assert max(sizes) == len({p for _, p in lines}) < len(pairs)


@pytest.fixture
def orders(spark, tmp_path, in_blocks, monkeypatch):
    """A folder with lines of great part keys, and their pairs; the cleaner is not called."""
    monkeypatch.setattr(lineage, "release", lambda spark: None)
    lines = [(o, (o * o + p * (o % 7 + 1)) % 90 + (1 << 40)) for o in range(300) for p in range(9)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = {}
    for o, p in lines:
        parts.setdefault(o, set()).add(p)
    return str(tmp_path), {pair for ps in parts.values() for pair in combinations(sorted(ps), 2)}


def stored(spark):
    """Names of the stored tables that are there."""
    folder = lineage.shared_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.startswith("stored-")} if os.path.isdir(folder) else set()


@pytest.mark.parametrize("large", [True, False])
def test_local_clustering_query_leaves_no_stored_edges(spark, orders, monkeypatch, large):
    folder, edges = orders
    if not large:
        monkeypatch.undo()
    before = stored(spark)
    found = queries.s8_local_clustering(spark, folder, None)
    assert stored(spark) <= before
    assert found.first()["coefficient"] == pytest.approx(max(l / p for l, p in clustering(edges).values() if p), abs=1e-8)


@pytest.mark.parametrize("large", [True, False])
def test_clustering_query_leaves_no_stored_edges(spark, orders, monkeypatch, large):
    folder, edges = orders
    if not large:
        monkeypatch.undo()
    before = stored(spark)
    found = queries.s9_clustering(spark, folder, None)
    assert stored(spark) <= before
    assert table(found) == pytest.approx({v: l / p if p else 0 for v, (l, p) in clustering(edges).items()}, abs=1e-8)


def test_clustering_query_leaves_no_shuffle_files(spark, orders):
    folder, edges = orders
    before = shuffled(spark)
    found = queries.s9_clustering(spark, folder, None)
    assert none_left(spark, before, 1000)
    assert table(found) == pytest.approx({v: l / p if p else 0 for v, (l, p) in clustering(edges).items()}, abs=1e-8)


def test_local_clustering_query_leaves_no_shuffle_files(spark, orders):
    folder, edges = orders
    before = shuffled(spark)
    found = queries.s8_local_clustering(spark, folder, None)
    assert none_left(spark, before, 1000)
    assert found.first()["coefficient"] == pytest.approx(max(l / p for l, p in clustering(edges).values() if p), abs=1e-8)
