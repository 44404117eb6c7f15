"""Reading GraphML and node-link JSON documents.

Documents are rows (doc, content); each is parsed in a task of its own, in parallel over
documents, into rows of vertices, edges and attributes.  What is wrong with a document comes
back as a row too and is raised as ``FormatError`` by the caller.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError
from ..graph import PropertyGraph
from ..plans.lineage import cut

SCHEMA = "doc long, kind string, ord long, a string, b string, weight double, attrs map<string,struct<type:string,value:string>>, note string"
COLUMNS = ["doc", "kind", "ord", "a", "b", "weight", "attrs", "note"]
#: Attribute types that GraphML names, and their Spark types; fixed by the format.
TYPES = {"string": "string", "boolean": "boolean", "int": "int", "long": "long", "float": "float", "double": "double"}


class _Bad(Exception):
    pass


@dataclass
class GraphDocument:
    """A graph with string ids and its attributes: maps of (type, value) on vertices and edges."""

    graph: PropertyGraph
    vertex_data: DataFrame
    edge_data: DataFrame

    @staticmethod
    def attribute(name: str, kind: str = "string"):
        """The column of an attribute, typed; null where it is missing."""
        return F.col("attrs").getItem(name).getField("value").cast(TYPES[kind])


# -- GraphML ------------------------------------------------------------------------------


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _typed(raw: str, kind: str, name: str) -> dict:
    """The value as text in its type's canonical form."""
    value = raw.strip()
    try:
        if kind == "boolean":
            if value not in ("true", "false", "1", "0"):
                raise ValueError
            value = "true" if value in ("true", "1") else "false"
        elif kind in ("int", "long"):
            n, bits = int(value), 32 if kind == "int" else 64
            if not -(1 << bits - 1) <= n < 1 << bits - 1:
                raise ValueError
            value = str(n)
        elif kind in ("float", "double"):
            value = repr(float(value))
        else:
            value = raw
    except ValueError:
        raise _Bad(f"attribute {name!r} is no {kind}: {raw!r}") from None
    return {"type": kind, "value": value}


def _graphml(content: str, weight_key: str | None, attributes: bool) -> Iterator[tuple]:
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        raise _Bad(f"no XML: {e}") from None
    graph = next((x for x in root.iter() if _local(x.tag) == "graph"), None)
    if graph is None:
        raise _Bad("there is no graph element")
    direction = graph.get("edgedefault")
    if direction not in ("directed", "undirected"):
        raise _Bad("the graph has no edgedefault")
    yield "graph", direction, None, None, None
    keys = {}
    for k in root:
        if _local(k.tag) == "key" and k.get("id") is not None:
            kind = k.get("attr.type")
            keys[k.get("id")] = (k.get("attr.name") or k.get("id"), kind if kind in TYPES else "string")
    for x in graph:
        tag = _local(x.tag)
        if tag not in ("node", "edge"):
            continue
        ends = ("id", None) if tag == "node" else ("source", "target")
        a, b = (x.get(k) if k else None for k in ends)
        if a is None or (tag == "edge" and b is None):
            raise _Bad(f"a {tag} lacks its {ends[0] if a is None else ends[1]}")
        data = {d.get("key"): "".join(d.itertext()) for d in x if _local(d.tag) == "data" and d.get("key") is not None}
        attrs, weight = {}, None
        if attributes:
            for key, raw in data.items():
                name, kind = keys.get(key, (key, "string"))
                attrs[name] = _typed(raw, kind, name)
        if tag == "edge" and weight_key is not None:
            try:
                weight = float(data.get(weight_key, "0"))
            except ValueError:
                raise _Bad(f"a weight is no number: {data[weight_key]!r}") from None
        yield tag, a, b, weight, attrs


# -- JSON ---------------------------------------------------------------------------------


def _text(item, name: str, what: str) -> str:
    value = item.get(name) if isinstance(item, dict) else None
    if not isinstance(value, str):
        raise _Bad(f"a {what} lacks its {name}")
    return value


def _scalars(item: dict, structural: tuple) -> dict:
    out = {}
    for k, v in item.items():
        if k in structural or v is None or isinstance(v, (list, dict)):
            continue
        if isinstance(v, bool):
            out[k] = {"type": "boolean", "value": str(v).lower()}
        elif isinstance(v, str):
            out[k] = {"type": "string", "value": v}
        else:
            out[k] = {"type": "double", "value": repr(float(v))}
    return out


def _node_link(content: str, weight_key: str | None, attributes: bool) -> Iterator[tuple]:
    try:
        root = json.loads(content)
    except ValueError as e:
        raise _Bad(f"no JSON: {e}") from None
    if not isinstance(root, dict) or not isinstance(root.get("directed"), bool):
        raise _Bad("the document has no boolean 'directed'")
    yield "graph", "directed" if root["directed"] else "undirected", None, None, None
    for name in ("nodes", "edges"):
        if not isinstance(root.get(name, []), list):
            raise _Bad(f"{name} is no array")
    for n in root.get("nodes", []):
        yield "node", _text(n, "id", "node"), None, None, _scalars(n, ("id",)) if attributes else {}
    for e in root.get("edges", []):
        s, t, weight = _text(e, "source", "edge"), _text(e, "target", "edge"), None
        if weight_key is not None:
            weight = e.get(weight_key, 0.0)
            if isinstance(weight, bool) or not isinstance(weight, (int, float)):
                raise _Bad(f"a weight is no number: {weight!r}")
        yield "edge", s, t, weight, _scalars(e, ("source", "target")) if attributes else {}


# -- documents ----------------------------------------------------------------------------


def parse_rows(documents: DataFrame, parser: Callable, weight_key: str | None, attributes: bool) -> DataFrame:
    """The rows of every document (doc, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch.doc, batch.content):
                rows = []
                try:
                    for k, (kind, a, b, w, attrs) in enumerate(parser(content or "", weight_key, attributes)):
                        rows.append((doc, kind, k, a, b, w, attrs or None, None))
                except _Bad as e:
                    rows = [(doc, "error", 0, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=COLUMNS)

    return documents.select(F.col("doc").cast("long"), "content").mapInPandas(run, SCHEMA)


def _read(spark: SparkSession, content: str, parser: Callable, directed: bool | None, weight_key: str | None, attributes: bool) -> GraphDocument:
    rows = cut(parse_rows(spark.createDataFrame([(0, content)], "doc long, content string"), parser, weight_key, attributes))
    head = rows.where("kind in ('error', 'graph')").select("kind", "a", "note").first()
    if head["kind"] == "error":
        raise FormatError(head["note"])
    found = head["a"] == "directed"
    if directed is not None and directed != found:
        raise FormatError(f"the document's graph is {head['a']}")
    nodes = rows.where("kind = 'node'").select(F.col("a").alias("id"), "ord", "attrs")
    edges = rows.where("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), "ord", F.col("ord").alias("eid"), *(["weight"] if weight_key else []))
    graph = PropertyGraph.from_dataframes(edges, nodes.select("id", "ord"), found, True)
    last = nodes.groupBy("id").agg(F.max_by("attrs", "ord").alias("attrs"))
    return GraphDocument(graph, last, rows.where("kind = 'edge'").select(F.col("ord").alias("eid"), "attrs"))


def parse_graphml(spark: SparkSession, content: str, directed: bool | None = None, weight_key: str | None = None) -> PropertyGraph:
    """A multigraph with string ids; with ``weight_key`` edges have weights, 0.0 where it is missing."""
    return _read(spark, content, _graphml, directed, weight_key, False).graph


def parse_graphml_document(spark: SparkSession, content: str) -> GraphDocument:
    return _read(spark, content, _graphml, None, None, True)


def parse_node_link(spark: SparkSession, content: str, directed: bool | None = None, weight_key: str | None = None) -> PropertyGraph:
    return _read(spark, content, _node_link, directed, weight_key, False).graph


def parse_node_link_document(spark: SparkSession, content: str) -> GraphDocument:
    return _read(spark, content, _node_link, None, None, True)
