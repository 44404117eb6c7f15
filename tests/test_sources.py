"""Hypergraphs, generators and text formats."""

import json
from xml.etree import ElementTree

import pytest
from helpers import column, graph, pairs, table
from pyspark.sql import functions as F

from graphloom.errors import FormatError
from graphloom.graph import PropertyGraph
from graphloom.hypergraph import Hypergraph, IncidenceVertex
from graphloom.operators import connectivity
from graphloom.sources import documents, generate, text_formats

NASTY = 'a "b" \\ <c> & #d;\ne'


def test_hypergraph(spark):
    g = Hypergraph.from_rows(spark, [["a", "b", "a"], ["b", "c", "d"], ["x", "y"]], ["lonely"])
    assert (g.vertex_count(), g.hyperedge_count()) == (7, 3)
    assert table(g.degrees())["b"] == 2 and table(g.degrees())["lonely"] == 0
    assert table(g.connected_components()) == {"lonely": "lonely", "a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert g.are_connected("a", "d") and not g.are_connected("a", "x") and g.are_connected("a", "a")
    clique = g.to_clique_expansion()
    assert clique.edge_count() == 5 and clique.vertex_count() == 7
    assert {tuple(sorted((r.src, r.dst))) for r in clique.edges.collect()} == {("a", "b"), ("b", "c"), ("b", "d"), ("c", "d"), ("x", "y")}
    incidence = g.to_incidence_graph()
    assert (incidence.vertex_count(), incidence.edge_count()) == (10, 7)
    ids = {IncidenceVertex.of(r["id"]) for r in incidence.vertices.collect()}
    assert IncidenceVertex.for_vertex("lonely") in ids and IncidenceVertex.for_hyperedge(2) in ids
    with pytest.raises(ValueError):
        IncidenceVertex.for_vertex("a").hyperedge_index
    assert g.remove_vertex("b").hyperedge_count() == 1
    assert g.remove_hyperedge(2).hyperedge_count() == 2 and g.clear().vertex_count() == 0
    more, hid = g.add_hyperedge(["a", "new"])
    assert hid == 3 and more.contains(3, "new") and more.vertex_count() == 8
    with pytest.raises(ValueError):
        g.add_hyperedge([])


def test_generators(spark):
    counts = {g.vertex_count(): g.edge_count() for g in (generate.complete(spark, 6), generate.cycle(spark, 5), generate.star(spark, 3), generate.path(spark, 7))}
    assert counts == {6: 15, 5: 5, 4: 3, 7: 6}
    assert generate.complete_bipartite(spark, 3, 4).edge_count() == 12
    assert generate.grid(spark, 4, 3).edge_count() == 17
    same = [generate.erdos_renyi(spark, 60, 0.2, 9).edges.select("src", "dst").orderBy("src", "dst").collect() for _ in range(2)]
    assert same[0] == same[1] and 0 < len(same[0]) < 60 * 59 / 2
    assert generate.erdos_renyi(spark, 10, 1.0, 1, directed=True).edge_count() == 90
    ba = generate.barabasi_albert(spark, 40, 2, 3).freeze()
    assert ba.edge_count() == 76 and connectivity.is_connected(ba) and ba.skeleton().count() == 76
    ws = generate.watts_strogatz(spark, 20, 4, 0.5, 3).freeze()
    assert ws.edge_count() == ws.skeleton().count() == 40
    for bad in (lambda: generate.cycle(spark, 2), lambda: generate.watts_strogatz(spark, 10, 3, 0.1, 1), lambda: generate.erdos_renyi(spark, 3, 2.0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_dot_and_mermaid(spark):
    g = graph(spark, [(NASTY, "x")], [], True)
    dot = text_formats.text(text_formats.to_dot(g, edge_label=F.lit("l")))
    quoted = '"a \\"b\\" \\\\ <c> & #d;\\ne"'
    assert dot == f'digraph "G" {{\n    {quoted};\n    "x";\n    {quoted} -> "x" [label="l"];\n}}\n'
    chart = text_formats.text(text_formats.to_mermaid(graph(spark, [(NASTY, "x")]), "LR"))
    assert chart == 'flowchart LR\n    v0["a #quot;b#quot; \\ <c> & #35;d;<br/>e"]\n    v1["x"]\n    v0 --- v1\n'
    with pytest.raises(ValueError):
        text_formats.to_mermaid(g, "UP")


@pytest.mark.parametrize("form", ["graphml", "json"])
def test_round_trips(spark, form):
    g = graph(spark, [("a", "b", 1.5), ("a", "b", 2.5), (NASTY, NASTY, 0.5)], ["island"], True, True)
    if form == "graphml":
        text = text_formats.text(text_formats.to_graphml(g, weight="weight"))
        ElementTree.fromstring(text)
        back = documents.parse_graphml(spark, text, True, "weight")
    else:
        text = text_formats.text(text_formats.to_node_link(g, weight="weight"))
        json.loads(text)
        back = documents.parse_node_link(spark, text, True, "weight")
    assert column(back.scan_vertices()) == ["island", "a", "b", NASTY]
    assert [(r.src, r.dst, r.weight) for r in back.scan_edges().collect()] == [("a", "b", 1.5), ("a", "b", 2.5), (NASTY, NASTY, 0.5)]


def test_attributes(spark):
    v = spark.createDataFrame([("Lisbon", 0, 545000, True, None), ("Porto", 1, 231000, False, 1.5)], "id string, ord long, population int, coastal boolean, area double")
    e = graph(spark, pairs("Lisbon-Porto")).edges.withColumn("kind", F.lit("road"))
    g = PropertyGraph(v, e, False)
    text = text_formats.text(text_formats.to_graphml(g, vertex_attributes=["population", "coastal", "area"], edge_attributes=["kind"]))
    assert 'attr.type="boolean"' in text and text.count('key="area"') == 1
    doc = documents.parse_graphml_document(spark, text)
    rows = {r["id"]: tuple(r)[1:] for r in doc.vertex_data.select("id", doc.attribute("population", "int"), doc.attribute("coastal", "boolean"), doc.attribute("area", "double")).collect()}
    assert rows == {"Lisbon": (545000, True, None), "Porto": (231000, False, 1.5)}
    assert doc.edge_data.select(doc.attribute("kind")).first()[0] == "road"
    doc = documents.parse_node_link_document(spark, text_formats.text(text_formats.to_node_link(g, vertex_attributes=["population", "coastal"])))
    assert doc.vertex_data.where("id = 'Porto'").select(doc.attribute("population", "double")).first()[0] == 231000.0


BAD = [
    "<graphml>", "<graphml/>", "<graphml><graph/></graphml>", '<graphml><graph edgedefault="directed"><node/></graph></graphml>',
    '<graphml><graph edgedefault="directed"><edge source="a"/></graph></graphml>',
]


@pytest.mark.parametrize("text", BAD)
def test_bad_graphml(spark, text):
    with pytest.raises(FormatError):
        documents.parse_graphml(spark, text)


@pytest.mark.parametrize("text", ["{", "[]", "{}", '{"directed": 1}', '{"directed": true, "nodes": {}}', '{"directed": true, "edges": [{"source": "a"}]}'])
def test_bad_json(spark, text):
    with pytest.raises(FormatError):
        documents.parse_node_link(spark, text)


def test_formats_are_lenient_where_they_should_be(spark):
    text = '<graphml xmlns="x"><graph edgedefault="undirected"><other/><edge source="a" target="b"/></graph></graphml>'
    g = documents.parse_graphml(spark, text, None, "weight")
    assert not g.directed and g.multi and column(g.edges, "weight") == [0.0] and g.vertex_count() == 2
    with pytest.raises(FormatError):
        documents.parse_graphml(spark, text, True)
    typed = '<graphml><key id="k" for="node" attr.name="n" attr.type="int"/><graph edgedefault="directed"><node id="a"><data key="k">x</data></node></graph></graphml>'
    with pytest.raises(FormatError):
        documents.parse_graphml_document(spark, typed)
    with pytest.raises(FormatError):
        documents.parse_node_link(spark, '{"directed": false, "edges": [{"source": "a", "target": "b", "weight": "x"}]}', None, "weight")
