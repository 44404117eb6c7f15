"""Containers: the same contract for directed and undirected, simple and parallel-edge graphs."""

import pytest
from helpers import column, graph, pairs, table
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph, directed, undirected
from graphloom.operators import connectivity

KINDS = [(d, m) for d in (True, False) for m in (True, False)]


@pytest.mark.parametrize("is_directed,multi", KINDS)
def test_contract(spark, is_directed, multi):
    g = graph(spark, pairs("a-b b-c c-c"), ["z"], is_directed, multi)
    assert (g.vertex_count(), g.edge_count()) == (4, 3)
    assert column(g.scan_vertices()) == ["z", "a", "b", "c"]
    assert g.contains_vertex("a") and not g.contains_vertex("q")
    assert g.contains_edge("a", "b") and g.contains_edge("b", "a") != is_directed
    assert table(g.degrees()) == {"z": 0, "a": 1, "b": 2, "c": 3}
    assert g.degree("c") == 3
    assert g.adjacent_edges("c").count() == 2
    # a loop is walked once
    assert g.arcs().where("src = 'c' and dst = 'c'").count() == 1
    with pytest.raises(ValueError):
        g.degree("q")
    gone = g.remove_vertices(spark.createDataFrame([("c",)], "id string"))
    assert (gone.vertex_count(), gone.edge_count()) == (3, 1)
    assert g.clear().vertex_count() == 0
    assert g.freeze().edge_count() == 3


@pytest.mark.parametrize("is_directed,multi", KINDS)
def test_equal_edges(spark, is_directed, multi):
    g = graph(spark, [("a", "b", 1), ("a", "b", 2), ("b", "a", 3)], [], is_directed, multi)
    expected = 3 if multi else (2 if is_directed else 1)
    assert g.edge_count() == expected
    assert 1 in column(g.get_edges("a", "b"), "weight")
    more = g.add_edges(spark.createDataFrame([("a", "b", 9), ("c", "a", 1)], "src string, dst string, weight long"))
    assert more.edge_count() == expected + (2 if multi else 1)
    assert column(more.scan_vertices())[-1] == "c"


def test_directed_degrees(spark):
    g = graph(spark, pairs("a-b a-c c-a a-a"), [], True)
    assert table(g.out_degrees()) == {"a": 3, "b": 0, "c": 1}
    assert table(g.in_degrees()) == {"a": 2, "b": 1, "c": 1}
    assert column(g.out_edges("a"), "dst") and g.in_edges("a").count() == 2
    with pytest.raises(ValueError):
        graph(spark, pairs("a-b")).out_degrees()


def test_remove_edge_by_payload_is_oriented(spark):
    g = graph(spark, [("a", "b", 1)])
    assert g.remove_edge("b", "a", weight=1).edge_count() == 1
    assert g.remove_edge("b", "a").edge_count() == 0
    many = graph(spark, [("a", "b", 1), ("a", "b", 1)], multi=True)
    assert many.remove_edge("a", "b").edge_count() == 1


def test_acyclic_insertion(spark):
    g = graph(spark, pairs("a-b b-c"), [], True)
    more = g.add_edges_acyclic(spark.createDataFrame([("c", "a"), ("a", "c"), ("d", "d"), ("c", "d"), ("d", "a")], "src string, dst string"))
    assert sorted((r.src, r.dst) for r in more.edges.collect()) == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")]


def test_identity_keeps_the_first_spelling(spark):
    e = spark.createDataFrame([("A", "b", 0), ("a", "B", 1)], "src string, dst string, ord long")
    g = PropertyGraph.from_dataframes(e, directed=True, identity=F.lower)
    assert g.edge_count() == 1
    assert table(g.vertices.select("id", "display")) == {"a": "A", "b": "b"}


def test_nulls_are_refused(spark):
    e = spark.createDataFrame([("a", None)], "src string, dst string")
    with pytest.raises(Exception, match="must not be null"):
        PropertyGraph.from_dataframes(e).edges.collect()
    with pytest.raises(ValueError):
        undirected(spark).add_edge("a", None).build()


def test_builder_keeps_insertion_order(spark):
    g = directed(spark).add_edge("x", "y", 2).add_vertex("a").add_edges([("a", "x", 1)]).build()
    assert column(g.scan_vertices()) == ["x", "y", "a"]
    assert [(r.src, r.weight) for r in g.scan_edges().collect()] == [("x", 2), ("a", 1)]


def test_matrix_order(spark):
    g = graph(spark, pairs("c-a b-a c-b"), ["a", "b", "c"])
    assert [(r.src, r.dst) for r in g.scan_edges().collect()] == [("b", "a"), ("c", "a"), ("c", "b")]
    assert [(r.src, r.dst) for r in g.scan_edges(matrix=True).collect()] == [("b", "a"), ("c", "a"), ("c", "b")]
    d = graph(spark, pairs("a-c a-b b-a"), ["a", "b", "c"], True)
    assert [(r.src, r.dst) for r in d.scan_edges(matrix=True).collect()] == [("a", "b"), ("a", "c"), ("b", "a")]


@pytest.mark.parametrize("is_directed,multi", KINDS)
def test_orders_stay_unique_over_changes(spark, is_directed, multi):
    g = graph(spark, [(1, 2), (2, 3)], [], is_directed, multi)
    g = g.add_vertices(spark.createDataFrame([(9,)], "id long"))
    for s, t in ((7, 8), (9, 5), (6, 1)):
        g = g.add_edges(spark.createDataFrame([(s, t)], "src long, dst long"))
    g = g.add_vertices(spark.createDataFrame([(4,), (9,)], "id long"))
    orders = [r.ord for r in g.vertices.collect()]
    assert len(set(orders)) == len(orders) == 9
    assert column(g.scan_vertices()) == [1, 2, 3, 9, 7, 8, 5, 6, 4]


def test_added_vertices_are_components_of_their_own(spark):
    g = graph(spark, [(1, 2), (2, 3)]).add_vertices(spark.createDataFrame([(9,)], "id long"))
    g = g.add_edges(spark.createDataFrame([(7, 8)], "src long, dst long"))
    found = {}
    for r in connectivity.connected_components(g).collect():
        found.setdefault(r.component, set()).add(r.id)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3], [7, 8], [9]]
