"""Traversal, cycles, components, condensation, bridges."""

import random

import pytest
from helpers import column, graph, pairs, random_edges, table

from graphloom.errors import Cancelled, GraphCycleError
from graphloom.operators import connectivity, traversal
from graphloom.plans import components
from graphloom.streaming import lazily


def in_order(df):
    return [r["id"] for r in df.orderBy("pos").collect()]


def test_traversals(spark):
    g = graph(spark, pairs("a-c a-b b-d c-d d-e"), ["e"], True)
    assert in_order(traversal.bfs(g, "a")) == ["a", "c", "b", "d", "e"]
    assert in_order(traversal.dfs(g, "a")) == ["a", "c", "d", "e", "b"]
    assert in_order(traversal.dfs(g, "a", post_order=True)) == ["e", "d", "c", "b", "a"]
    assert [r["id"] for _, r in zip(range(2), lazily(traversal.bfs(g, "a"), "pos"))] == ["a", "c"]
    assert in_order(traversal.bfs(g, "e")) == ["e"]
    with pytest.raises(ValueError):
        traversal.bfs(g, "q")


def test_topological_order(spark):
    g = graph(spark, pairs("b-c a-c c-d a-d c-d"), ["x", "b", "a"], True, True)
    assert in_order(traversal.topological_order(g)) == ["x", "b", "a", "c", "d"]
    with pytest.raises(GraphCycleError) as e:
        traversal.topological_order(graph(spark, pairs("a-b b-c c-b"), [], True))
    assert sorted(e.value.cycle) == ["b", "c"]


@pytest.mark.parametrize("together", [32, 2])
def test_topological_order_over_many_levels(spark, monkeypatch, together):
    """Against Kahn's order with a queue."""
    monkeypatch.setattr(traversal, "LEVELS_TOGETHER", together)
    rng = random.Random(5)
    edges = [(a, b) for a, b in (sorted(rng.sample(range(12), 2)) for _ in range(16))]
    g = graph(spark, edges, range(12), True, True)
    missing, queue = {v: sum(b == v for _, b in edges) for v in range(12)}, []
    queue += [v for v in range(12) if not missing[v]]
    for v in queue:
        for a, b in edges:
            if a == v:
                missing[b] -= 1
                queue += [] if missing[b] else [b]
    assert in_order(traversal.topological_order(g)) == queue


def test_cycles(spark):
    assert not traversal.has_cycle(graph(spark, pairs("a-b b-c")))
    assert traversal.has_cycle(graph(spark, pairs("a-b a-b"), multi=True))
    assert traversal.find_cycle(graph(spark, pairs("a-a"))) == ["a"]
    assert sorted(traversal.find_cycle(graph(spark, pairs("a-b b-c c-a c-d")))) == ["a", "b", "c"]
    assert traversal.find_cycle(graph(spark, pairs("a-b a-c b-d c-d"), [], True)) is None
    assert sorted(traversal.find_cycle(graph(spark, pairs("a-b b-c c-d d-b"), [], True))) == ["b", "c", "d"]


def test_components(spark):
    g = graph(spark, pairs("d-c x-y"), ["b", "c"])
    assert table(connectivity.connected_components(g)) == {"b": "b", "c": "c", "d": "c", "x": "x", "y": "x"}
    assert not connectivity.is_connected(g)
    assert connectivity.is_connected(graph(spark, []))


@pytest.mark.parametrize("at_once", [0, 10_000])
def test_star_components_against_union_find(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = table(components.star_components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")), "node")
    assert got == {a: find(a) for a in parent}


def brute_reach(edges, n):
    reach = {v: {v} for v in range(n)}
    for _ in range(n):
        for a, b, *_ in edges:
            for v in range(n):
                if a in reach[v]:
                    reach[v].add(b)
    return reach


def test_strong_components(spark):
    edges = random_edges(3, 14, 22, False)
    g = graph(spark, edges, range(14), True, True)
    reach = brute_reach(edges, 14)
    expected = {v: min(u for u in range(14) if u in reach[v] and v in reach[u]) for v in range(14)}
    assert table(connectivity.strongly_connected_components(g)) == expected
    members, arcs = connectivity.condense(g)
    number = table(members)
    assert len(set(number.values())) == len(set(expected.values()))
    links = {(number[a], number[b]) for a, b in edges if number[a] != number[b]}
    assert {(r.src, r.dst) for r in arcs.collect()} == links and all(a > b for a, b in links)


def test_bridges_and_articulation_points(spark):
    g = graph(spark, pairs("a-b b-c c-a c-d d-e d-e e-f"), multi=True)
    assert {(r.src, r.dst) for r in connectivity.find_bridges(g).collect()} == {("c", "d"), ("e", "f")}
    assert set(column(connectivity.find_articulation_points(g))) == {"c", "d", "e"}
    with pytest.raises(ValueError):
        connectivity.find_bridges(graph(spark, pairs("a-b"), [], True))


def test_cancellation(spark):
    with pytest.raises(Cancelled):
        traversal.bfs(graph(spark, pairs("a-b")), "a", should_stop=lambda: True)
