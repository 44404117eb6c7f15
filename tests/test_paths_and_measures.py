"""Paths, distance metrics and centrality: golden graphs and seeded cross-checks."""

import math
from itertools import permutations

import pytest
from helpers import column, graph, pairs, random_edges, table

from graphloom.errors import DisconnectedGraphError, GraphCycleError, NegativeCycleError, NegativeWeightError
from graphloom.functions import fanout
from graphloom.operators import centrality, metrics, paths
from graphloom.sources import generate


def test_golden_paths(spark):
    g = graph(spark, pairs("a-b:3 b-c:2 a-c:7 c-a:1"), [], True)
    all_pairs = paths.FloydWarshall("weight").compute(g)
    got = {(r.source, r.target): r.distance for r in all_pairs.rows.collect()}
    assert [got[p] for p in (("a", "b"), ("a", "c"), ("c", "b"), ("b", "a"), ("a", "a"))] == [3, 5, 4, 3, 0]
    assert all_pairs.between("a", "c").path == ["a", "b", "c"]
    assert paths.shortest_path(g, "a", "c").path == ["a", "b", "c"]
    neg = graph(spark, [("a", "c", 2), ("a", "b", 3), ("b", "c", -2)], [], True)
    found = paths.BellmanFord("weight").find_path(neg, "a", "c")
    assert (found.distance, found.path) == (1, ["a", "b", "c"])
    assert not paths.shortest_path(g, "a", "b", weight=None).path == []


def test_unreachable_and_unknown(spark):
    g = graph(spark, pairs("a-b:1"), ["z"], True)
    found = paths.shortest_path(g, "b", "z")
    assert not found.is_reachable and found.path == []
    with pytest.raises(ValueError):
        found.distance
    with pytest.raises(ValueError):
        paths.shortest_path(g, "a", "q")


def test_negative_weights(spark):
    g = graph(spark, [("a", "b", 1), ("b", "c", 4), ("c", "d", -1), ("x", "a", -5)], [], True)
    assert paths.Dijkstra("weight").find_path(g, "a", "b").distance == 1
    with pytest.raises(NegativeWeightError):
        paths.Dijkstra("weight").find_paths_from(g, "a")
    cycle = graph(spark, [("a", "b", 1), ("c", "d", -3), ("d", "c", 1)], [], True)
    assert table(paths.BellmanFord("weight").find_paths_from(cycle, "a").distances) == {"a": 0, "b": 1}
    with pytest.raises(NegativeCycleError):
        paths.BellmanFord("weight").find_paths_from(cycle, "c")
    with pytest.raises(NegativeCycleError):
        paths.FloydWarshall("weight").compute(cycle)
    with pytest.raises(NegativeCycleError):
        paths.BellmanFord("weight").find_paths_from(graph(spark, [("a", "b", -1)]), "a")


def test_dag_paths(spark):
    g = graph(spark, pairs("a-b:1 a-c:4 b-c:2 c-d:1"), [], True)
    found = paths.dag_shortest_paths_from(g, "a")
    assert table(found.distances) == {"a": 0, "b": 1, "c": 3, "d": 4} and found.to("d").path == list("abcd")
    assert paths.dag_longest_paths_from(g, "a").to("d").distance == 5
    critical = paths.critical_path(g)
    assert (critical.distance, critical.path) == (5, ["a", "c", "d"])
    with pytest.raises(GraphCycleError):
        paths.dag_shortest_paths_from(graph(spark, pairs("a-b:1 x-y:1 y-x:1"), [], True), "a")
    alone = paths.critical_path(graph(spark, [("a", "b", -1)], [], True))
    assert (alone.distance, alone.path) == (0, ["a"])


def test_a_star_on_a_grid(spark):
    g = generate.grid(spark, 5, 4)
    g = g.with_edges(g.edges.selectExpr("*", "1L as weight"))
    manhattan = lambda a, b: abs(a % 5 - b % 5) + abs(a // 5 - b // 5)
    found = paths.AStar("weight", manhattan).find_path(g, 0, 19)
    assert found.distance == 7 and len(found.path) == 8
    assert all(abs(a - b) in (1, 5) for a, b in zip(found.path, found.path[1:]))


def brute_distances(edges, n, directed):
    d = {(i, j): 0 if i == j else math.inf for i in range(n) for j in range(n)}
    for a, b, w in edges:
        d[a, b] = min(d[a, b], w)
        if not directed:
            d[b, a] = min(d[b, a], w)
    for k in range(n):
        for i in range(n):
            for j in range(n):
                d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return {p: x for p, x in d.items() if x < math.inf}


@pytest.mark.parametrize("directed", [True, False])
def test_all_algorithms_agree(spark, directed):
    edges = random_edges(11, 12, 30)
    g = graph(spark, edges, range(12), directed, True).freeze()
    expected = brute_distances(edges, 12, directed)
    got = paths.FloydWarshall("weight").compute(g).rows.collect()
    assert {(r.source, r.target): r.distance for r in got} == expected
    one = {t: d for (s, t), d in expected.items() if s == 0}
    assert table(paths.Dijkstra("weight").find_paths_from(g, 0).distances) == one
    assert table(paths.BellmanFord("weight").find_paths_from(g, 0).distances) == one


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_fan_out_and_its_distributed_form(spark, monkeypatch, sent):
    edges = random_edges(2, 7, 12)
    g = graph(spark, edges, range(7), True, True).freeze()
    expected = brute_distances(edges, 7, True)
    monkeypatch.setattr(fanout, "SENT_ARCS", sent)
    closeness = {}
    for v in range(7):
        d = [x for (s, _), x in expected.items() if s == v]
        r = len(d) - 1
        closeness[v] = r / 6 * r / sum(d) if r and sum(d) else 0.0
    assert table(centrality.closeness_centrality(g, "weight")) == pytest.approx(closeness)
    # every simple path's length, the shortest ones counted with parallel edges
    through = dict.fromkeys(range(7), 0.0)
    for s, t in permutations(range(7), 2):
        if (s, t) not in expected:
            continue
        ways = {}
        todo = [([s], 0, 1)]
        while todo:
            path, length, k = todo.pop()
            if path[-1] == t:
                if length == expected[s, t]:
                    ways[tuple(path)] = ways.get(tuple(path), 0) + k
                continue
            for a, b, w in edges:
                if a == path[-1] and b not in path:
                    todo.append(([*path, b], length + w, k))
        total = sum(ways.values())
        for path, k in ways.items():
            for v in path[1:-1]:
                through[v] += k / total
    assert table(centrality.betweenness_centrality(g, "weight")) == pytest.approx(through)


def test_golden_centrality(spark):
    star = generate.star(spark, 4)
    assert table(centrality.degree_centrality(star)) == {0: 1.0, **{k: 0.25 for k in range(1, 5)}}
    assert table(centrality.betweenness_centrality(star))[0] == 6
    assert table(centrality.closeness_centrality(star))[1] == pytest.approx(4 / 7)
    assert set(table(centrality.betweenness_centrality(generate.cycle(spark, 4))).values()) == {0.5}
    island = graph(spark, pairs("a-b"), ["island"])
    assert table(centrality.closeness_centrality(island)) == {"island": 0.0, "a": 0.5, "b": 0.5}
    ranks = table(centrality.pagerank(graph(spark, pairs("a-b c-b"), [], True), tolerance=1e-6))
    assert sum(ranks.values()) == pytest.approx(1) and ranks["b"] > ranks["a"]
    eigen = table(centrality.eigenvector_centrality(graph(spark, pairs("a-b b-c")), tolerance=1e-7))
    assert eigen == pytest.approx({"a": 0.5, "b": math.sqrt(2) / 2, "c": 0.5}, abs=1e-5)
    katz = table(centrality.katz_centrality(graph(spark, pairs("a-b"), [], True), tolerance=1e-9))
    assert katz["b"] / katz["a"] == pytest.approx(1.1)
    with pytest.raises(NegativeWeightError):
        centrality.betweenness_centrality(graph(spark, pairs("a-b:0")), "weight")
    with pytest.raises(ValueError):
        centrality.pagerank(graph(spark, pairs("a-b"), [], True), damping=1.5)


def test_metrics(spark):
    path = generate.path(spark, 4)
    assert (metrics.diameter(path), metrics.radius(path)) == (3, 2)
    assert sorted(column(metrics.center(path))) == [1, 2] and sorted(column(metrics.periphery(path))) == [0, 3]
    assert metrics.average_path_length(path) == pytest.approx(5 / 3)
    assert metrics.eccentricity(path, 1) == 2
    for g in (graph(spark, pairs("a-b"), ["z"]), graph(spark, pairs("a-b"), [], True), graph(spark, [])):
        with pytest.raises(DisconnectedGraphError):
            metrics.diameter(g)
