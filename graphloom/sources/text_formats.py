"""Writing graphs as DOT, Mermaid, GraphML and node-link JSON.

Each writer gives a DataFrame of (section, a, b, line), one row a line, so a document of
any size is made and saved in parallel; ``text`` gathers a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.supersteps import ranked

#: GraphML type names by Spark type, fixed by the format.
GRAPHML_TYPES = {"string": "string", "boolean": "boolean", "int": "int", "bigint": "long", "float": "float", "double": "double"}
GRAPHML_NAMESPACE = "http://graphml.graphdrawing.org/xmlns"
MERMAID_DIRECTIONS = ("TD", "LR", "BT", "RL")
FIRST, NODES, MIDDLE, EDGES, LAST = range(5)


def text(lines: DataFrame) -> str:
    """The whole document as a string, for documents that fit the driver."""
    return "".join(r["line"] + "\n" for r in lines.orderBy("section", "a", "b").toLocalIterator())


def save(lines: DataFrame, path: str) -> None:
    """Text files that, read in name order, are the document."""
    lines.repartitionByRange("section", "a", "b").sortWithinPartitions("section", "a", "b").select("line").write.text(path)


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _fixed(g: PropertyGraph, section: int, *lines: str) -> DataFrame:
    rows = [(section, k, 0, line) for k, line in enumerate(lines)]
    return g.vertices.sparkSession.createDataFrame(rows, "section int, a long, b long, line string")


def _lines(df: DataFrame, section: int, a: str, b: Column, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(a).cast("long").alias("a"), b.cast("long").alias("b"), line.alias("line"))


def _joined(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dot_quoted(c: Column) -> Column:
    c = _replaced(c.cast("string"), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "")])
    return F.concat(F.lit('"'), c, F.lit('"'))


def to_dot(g: PropertyGraph, name: str = "G", vertex_label: Column | None = None, edge_label: Column | None = None) -> DataFrame:
    """Labels are columns over the vertices (id, ...) and edges."""
    label = dot_quoted(F.col("id") if vertex_label is None else vertex_label)
    v = g.vertices.withColumn("_l", label)
    e = g.edges_with_ords().join(v.select(F.col("id").alias("src"), F.col("_l").alias("_s")), "src").join(v.select(F.col("id").alias("dst"), F.col("_l").alias("_t")), "dst")
    arrow = " -> " if g.directed else " -- "
    tail = F.lit(";") if edge_label is None else F.concat(F.lit(" [label="), dot_quoted(edge_label), F.lit("];"))
    quoted = name.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "")
    return _joined(
        _fixed(g, FIRST, f'{"digraph" if g.directed else "graph"} "{quoted}" {{'),
        _lines(v, NODES, "ord", F.lit(0), F.concat(F.lit("    "), "_l", F.lit(";"))),
        _lines(e, EDGES, "src_ord", F.col("ord"), F.concat(F.lit("    "), "_s", F.lit(arrow), "_t", tail)),
        _fixed(g, LAST, "}"),
    )


def mermaid_escaped(c: Column) -> Column:
    return _replaced(c.cast("string"), [("#", "#35;"), ('"', "#quot;"), ("\n", "<br/>"), ("\r", "")])


def to_mermaid(g: PropertyGraph, direction: str = "TD", vertex_label: Column | None = None, edge_label: Column | None = None) -> DataFrame:
    """A flowchart whose ids v0, v1, ... follow the vertices' order."""
    if direction not in MERMAID_DIRECTIONS:
        raise ValueError(f"a direction is one of {MERMAID_DIRECTIONS}")
    label = mermaid_escaped(F.col("id") if vertex_label is None else vertex_label)
    v = ranked(g.vertices, F.col("ord"), name="_n").withColumns({"_l": label, "_v": F.concat(F.lit("v"), F.col("_n").cast("string"))})
    e = g.edges_with_ords().join(v.select(F.col("id").alias("src"), F.col("_v").alias("_s")), "src").join(v.select(F.col("id").alias("dst"), F.col("_v").alias("_t")), "dst")
    arrow = " -->" if g.directed else " ---"
    middle = F.lit(" ") if edge_label is None else F.concat(F.lit('|"'), mermaid_escaped(edge_label), F.lit('"| '))
    return _joined(
        _fixed(g, FIRST, f"flowchart {direction}"),
        _lines(v, NODES, "ord", F.lit(0), F.concat(F.lit("    "), "_v", F.lit('["'), "_l", F.lit('"]'))),
        _lines(e, EDGES, "src_ord", F.col("ord"), F.concat(F.lit("    "), "_s", F.lit(arrow), middle, "_t")),
    )


def xml_escaped(c: Column) -> Column:
    return _replaced(
        c.cast("string"),
        [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")],
    )


def _xml_value(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    # xml has true and false; Spark's casts of booleans are the same words
    return xml_escaped(c)


def _xml_data(df: DataFrame, names: list[str]) -> list[Column]:
    """One element for each attribute, none for a null."""
    return [F.coalesce(F.concat(F.lit(f'\n      <data key="{n}">'), _xml_value(df, n), F.lit("</data>")), F.lit("")) for n in names]


def to_graphml(
    g: PropertyGraph,
    graph_id: str = "G",
    weight: str | None = None,
    vertex_attributes: list[str] = (),
    edge_attributes: list[str] = (),
) -> DataFrame:
    """Attributes are columns, typed by their Spark types; a weight comes first, as a double."""
    keys = []
    if weight is not None:
        keys.append('  <key id="weight" for="edge" attr.name="weight" attr.type="double" />')
    for names, df, domain in ((vertex_attributes, g.vertices, "node"), (edge_attributes, g.edges, "edge")):
        for n in names:
            kind = GRAPHML_TYPES.get(df.schema[n].dataType.simpleString())
            if kind is None:
                raise ValueError(f"attribute {n} has a type that GraphML lacks")
            keys.append(f'  <key id="{n}" for="{domain}" attr.name="{n}" attr.type="{kind}" />')
    direction = "directed" if g.directed else "undirected"

    def element(head: Column, data: list[Column], tag: str) -> Column:
        body = F.concat(*data) if data else F.lit("")
        return F.concat(head, F.when(body == "", F.lit(" />")).otherwise(F.concat(F.lit(">"), body, F.lit(f"\n    </{tag}>"))))

    node = F.concat(F.lit('    <node id="'), xml_escaped(F.col("id")), F.lit('"'))
    edge = F.concat(F.lit('    <edge source="'), xml_escaped(F.col("src")), F.lit('" target="'), xml_escaped(F.col("dst")), F.lit('"'))
    edge_data = _xml_data(g.edges, list(edge_attributes))
    if weight is not None:
        edge_data.insert(0, F.concat(F.lit('\n      <data key="weight">'), F.col(weight).cast("double").cast("string"), F.lit("</data>")))
    return _joined(
        _fixed(g, FIRST, f'<graphml xmlns="{GRAPHML_NAMESPACE}">', *keys, f'  <graph id="{graph_id}" edgedefault="{direction}">'),
        _lines(g.vertices, NODES, "ord", F.lit(0), element(node, _xml_data(g.vertices, list(vertex_attributes)), "node")),
        _lines(g.edges_with_ords(), EDGES, "src_ord", F.col("ord"), element(edge, edge_data, "edge")),
        _fixed(g, LAST, "  </graph>", "</graphml>"),
    )


def to_node_link(g: PropertyGraph, weight: str | None = None, vertex_attributes: list[str] = (), edge_attributes: list[str] = ()) -> DataFrame:
    """JSON with ``directed``, ``nodes`` and ``edges``; null attributes are left out."""
    node = F.to_json(F.struct(F.col("id").cast("string").alias("id"), *vertex_attributes))
    weights = [F.col(weight).alias("weight")] if weight is not None else []
    edge = F.to_json(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), *weights, *edge_attributes))
    first_node = g.vertices.agg(F.min("ord")).first()[0]
    e = g.edges_with_ords()
    first_edge = e.agg(F.min(F.struct("src_ord", "ord").alias("x")).alias("x")).first()["x"]
    at = F.lit(False) if first_edge is None else (F.col("src_ord") == first_edge["src_ord"]) & (F.col("ord") == first_edge["ord"])
    comma = lambda first: F.when(first, F.lit("    ")).otherwise(F.lit("    ,"))
    return _joined(
        _fixed(g, FIRST, "{", f'  "directed": {str(g.directed).lower()},', '  "nodes": ['),
        _lines(g.vertices, NODES, "ord", F.lit(0), F.concat(comma(F.col("ord") == F.lit(first_node)), node)),
        _fixed(g, MIDDLE, "  ],", '  "edges": ['),
        _lines(e, EDGES, "src_ord", F.col("ord"), F.concat(comma(at), edge)),
        _fixed(g, LAST, "  ]", "}"),
    )
