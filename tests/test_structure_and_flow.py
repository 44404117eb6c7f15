"""Structure, set operations, forests, flows, matchings and trails."""

from itertools import combinations

import pytest
from helpers import column, graph, pairs, random_edges, table

from graphloom.errors import GraphCycleError, NegativeWeightError
from graphloom.operators import euler, flow, matching, setops, spanning, structure
from graphloom.sources import generate


def ends(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_density_and_degrees(spark):
    g = graph(spark, pairs("a-b b-c a-a"))
    assert structure.density(g) == 1.0
    assert column(structure.degree_sequence(g), "degree") == [3, 2, 1]


def test_bipartition(spark):
    g = graph(spark, pairs("a-b c-b d-e"), ["z"])
    assert table(structure.find_bipartition(g)) == {"z": "left", "a": "left", "b": "right", "c": "left", "d": "left", "e": "right"}
    assert not structure.is_bipartite(generate.cycle(spark, 5))
    assert structure.is_bipartite(generate.cycle(spark, 6))
    assert structure.find_bipartition(graph(spark, pairs("a-a"))) is None


def test_closure_and_reduction(spark):
    g = graph(spark, pairs("a-b b-c c-a c-d"), [], True)
    closed = set(ends(structure.transitive_closure(g).edges))
    assert closed == {(x, y) for x in "abc" for y in "abcd"}
    dag = graph(spark, pairs("a-b b-c a-c a-c c-d a-d"), [], True, True)
    assert ends(structure.transitive_reduction(dag).edges) == [("a", "b"), ("b", "c"), ("c", "d")]
    with pytest.raises(GraphCycleError):
        structure.transitive_reduction(g)
    assert ends(structure.transpose(g).edges) == sorted((b, a) for a, b in ends(g.edges))


def test_clustering_against_brute_force(spark):
    edges = random_edges(8, 10, 26, False)
    g = graph(spark, edges, range(10), False, True)
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in range(10)}
    expected, links, possible = {}, 0, 0
    for v, n in near.items():
        n = n - {v}
        k = len(n) * (len(n) - 1) / 2
        got = sum(1 for a, b in combinations(sorted(n), 2) if b in near[a])
        expected[v] = got / k if k else 0.0
        links, possible = links + got, possible + k
    assert table(structure.clustering_coefficients(g)) == pytest.approx(expected)
    assert structure.local_clustering_coefficient(g, 3) == pytest.approx(expected[3])
    assert structure.average_clustering_coefficient(g) == pytest.approx(sum(expected.values()) / 10)
    assert structure.global_clustering_coefficient(g) == pytest.approx(links / possible)


def test_cliques_and_colours(spark):
    edges = random_edges(21, 9, 22, False)
    g = graph(spark, edges, range(9), False, True)
    near = {frozenset(e) for e in edges if e[0] != e[1]}
    cliques = [set(c) for k in range(1, 10) for c in combinations(range(9), k) if all(frozenset(p) in near for p in combinations(c, 2))]
    maximal = sorted(sorted(c) for c in cliques if not any(c < d for d in cliques))
    assert sorted(column(structure.maximal_cliques(g), "clique")) == maximal
    plain = graph(spark, [e for e in edges if e[0] != e[1]], range(9))
    colour = table(structure.color_vertices(plain))
    assert len(colour) == 9 and all(colour[a] != colour[b] for a, b in edges if a != b)
    even = structure.color_vertices(generate.cycle(spark, 6))
    assert structure.color_count(even) == 2
    with pytest.raises(ValueError):
        structure.color_vertices(graph(spark, pairs("a-a")))


def test_set_operations(spark):
    g = graph(spark, pairs("a-b:1 b-c:2 c-d:3"))
    part = setops.subgraph(g, spark.createDataFrame([("c",), ("b",), ("q",)], "id string"))
    assert ends(part.edges) == [("b", "c")] and part.vertex_count() == 2
    both = setops.union(g, graph(spark, pairs("b-a:9 d-e:4")))
    assert sorted((r.src, r.dst, r.weight) for r in both.edges.collect()) == [("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("d", "e", 4)]
    assert column(both.scan_vertices()) == list("abcde")
    assert ends(setops.complement(g).edges) == [("a", "c"), ("a", "d"), ("b", "d")]
    with pytest.raises(ValueError):
        setops.union(g, graph(spark, pairs("a-b:1"), [], True))
    with pytest.raises(ValueError):
        setops.complement(graph(spark, pairs("a-b"), multi=True))


def test_forest_is_the_one_of_a_sorted_scan(spark):
    edges = random_edges(4, 15, 40)
    g = graph(spark, edges, range(15), False, True)
    parent = list(range(15))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    # enumeration: by source vertex, then insertion
    expected = []
    for (a, b, w), k in sorted(zip(edges, range(len(edges))), key=lambda x: (x[0][2], x[0][0], x[1])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            expected.append(k)
    assert sorted(column(spanning.Kruskal().find(g), "ord")) == sorted(expected)
    assert spanning.Prim().find(g).count() == len(expected)
    with pytest.raises(ValueError):
        spanning.minimum_spanning_forest(graph(spark, pairs("a-b:1"), [], True))


@pytest.mark.parametrize("algorithm", [flow.EdmondsKarp, flow.Dinic])
def test_flow(spark, algorithm):
    g = graph(spark, pairs("s-v1:16 s-v2:13 v1-v3:12 v2-v1:4 v2-v4:14 v3-v2:9 v3-t:20 v4-v3:7 v4-t:4 v1-dead:5 t-t:1"), [], True)
    found = algorithm().find(g, "s", "t")
    assert found.flow_value == 23
    assert found.min_cut_edges.selectExpr("sum(capacity)").first()[0] == 23
    flows = found.edge_flows.collect()
    assert len(flows) == 10 and all(r.src != r.dst for r in flows)
    for v in ("v1", "v2", "v3", "v4", "dead"):
        assert sum(r.flow for r in flows if r.src == v) == sum(r.flow for r in flows if r.dst == v)
    assert set(column(found.source_side)) == {"s", "v1", "v2", "v4", "dead"}
    with pytest.raises(ValueError):
        algorithm().find(g, "s", "s")
    with pytest.raises(NegativeWeightError):
        algorithm().find(graph(spark, [("a", "b", -1)], [], True), "a", "b")


def test_flow_algorithms_agree(spark):
    edges = random_edges(17, 8, 30)
    g = graph(spark, edges, range(8), True, True).freeze()
    values = [a().find(g, 0, 7) for a in (flow.EdmondsKarp, flow.Dinic)]
    assert values[0].flow_value == values[1].flow_value
    assert sorted(column(values[0].source_side)) == sorted(column(values[1].source_side))


def test_matching_against_unit_flow(spark):
    edges = sorted({(a, 20 + b) for a, b in random_edges(6, 9, 24, False)})
    g = graph(spark, edges)
    chosen = matching.maximum_bipartite_matching(g).collect()
    used = [v for r in chosen for v in (r.src, r.dst)]
    assert len(used) == len(set(used))
    net = [(-1, a, 1) for a in {a for a, _ in edges}] + [(b, 99, 1) for b in {b for _, b in edges}] + [(a, b, 1) for a, b in edges]
    assert len(chosen) == flow.maximum_flow(graph(spark, net, [], True), -1, 99).flow_value
    with pytest.raises(ValueError):
        matching.maximum_bipartite_matching(generate.cycle(spark, 3))


def walked(rows, count):
    rows = sorted(rows, key=lambda r: r.pos)
    assert len({r.eid for r in rows}) == len(rows) == count
    assert all(a.to_id == b.from_id for a, b in zip(rows, rows[1:]))
    return rows


def test_euler(spark):
    bridges = graph(spark, pairs("n-i n-i s-i s-i n-e s-e i-e"), multi=True)
    assert not euler.has_eulerian_path(bridges) and euler.find_eulerian_circuit(bridges) is None
    eight = graph(spark, pairs("a-b b-c c-a a-d d-e e-a"))
    rows = walked(euler.find_eulerian_circuit(eight).collect(), 6)
    assert rows[0].from_id == rows[-1].to_id
    line = graph(spark, pairs("b-a b-c c-d"), [], True)
    assert not euler.has_eulerian_path(line)
    open_walk = graph(spark, pairs("a-b b-c c-a a-d"), [], True)
    rows = walked(euler.find_eulerian_path(open_walk).collect(), 4)
    assert (rows[0].from_id, rows[-1].to_id) == ("a", "d")
    assert euler.has_eulerian_circuit(graph(spark, [], ["a", "b"]))
    assert not euler.has_eulerian_circuit(graph(spark, pairs("a-b b-a x-x"), [], True))
