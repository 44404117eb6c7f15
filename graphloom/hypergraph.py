"""Hypergraphs as an incidence table (hid, v) and a vertex table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph, first_by, in_order, never_null
from .plans.components import star_components
from .plans.lineage import cut


@dataclass(frozen=True)
class IncidenceVertex:
    """A vertex of the incidence graph: a vertex of the hypergraph or the number of a hyperedge."""

    is_hyperedge: bool
    _vertex: Any = None
    _hyperedge_index: int | None = None

    @classmethod
    def for_vertex(cls, v: Any) -> IncidenceVertex:
        if v is None:
            raise ValueError("a vertex must not be null")
        return cls(False, v)

    @classmethod
    def for_hyperedge(cls, index: int) -> IncidenceVertex:
        if index < 0:
            raise ValueError("a hyperedge's number must not be negative")
        return cls(True, None, index)

    @classmethod
    def of(cls, row) -> IncidenceVertex:
        """That of an id in ``to_incidence_graph``."""
        return cls(row["is_hyperedge"], row["vertex"], row["hyperedge_index"])

    @property
    def vertex(self) -> Any:
        if self.is_hyperedge:
            raise ValueError("this is a hyperedge")
        return self._vertex

    @property
    def hyperedge_index(self) -> int:
        if not self.is_hyperedge:
            raise ValueError("this is a vertex")
        return self._hyperedge_index


class Hypergraph:
    """Vertices (id, ord) and incidences (hid, v); each hid is a hyperedge of its own, equal sets included."""

    def __init__(self, vertices: DataFrame, incidence: DataFrame):
        self.vertices, self.incidence = vertices, incidence

    @classmethod
    def from_dataframe(cls, incidence: DataFrame, vertices: DataFrame | None = None) -> Hypergraph:
        """Rows (hid, v), repeats within a hyperedge ignored; vertices that only they name are added by id."""
        rows = incidence.select(F.col("hid").cast("long").alias("hid"), never_null("v").alias("v")).distinct()
        named = rows.select(F.col("v").alias("id")).distinct()
        if vertices is None:
            return cls(in_order(named, F.col("id")), rows)
        given = vertices if "ord" in vertices.columns else in_order(vertices.select("id"), F.col("id"))
        new = in_order(named.join(given.select("id"), "id", "left_anti"), F.col("id")).withColumn("ord", F.col("ord") + F.lit(1 << 61))
        return cls(first_by(given.select("id", "ord").unionByName(new.select("id", "ord")), ["id"], "ord"), rows)

    @classmethod
    def from_rows(cls, spark: SparkSession, hyperedges: list, vertices: list = ()) -> Hypergraph:
        """A hypergraph of vertex collections, numbered from 0."""
        if any(not list(h) for h in hyperedges):
            raise ValueError("a hyperedge must have a vertex")
        order = list(dict.fromkeys([*vertices, *(v for h in hyperedges for v in h)]))
        kind = spark.createDataFrame([(order[0] if order else 0,)], ["v"]).schema["v"].dataType.simpleString()
        rows = [(k, v) for k, h in enumerate(hyperedges) for v in dict.fromkeys(h)]
        v = spark.createDataFrame(list(zip(order, range(len(order)))), f"id {kind}, ord long")
        return cls(v, spark.createDataFrame(rows, f"hid long, v {kind}"))

    def vertex_count(self) -> int:
        return self.vertices.count()

    def hyperedges(self) -> DataFrame:
        """(hid, size)."""
        return self.incidence.groupBy("hid").agg(F.count(F.lit(1)).alias("size"))

    def hyperedge_count(self) -> int:
        return self.incidence.select("hid").distinct().count()

    def contains_vertex(self, v: Any) -> bool:
        return not self.vertices.where(F.col("id") == F.lit(v)).isEmpty()

    def contains(self, hid: int, v: Any) -> bool:
        return not self.incidence.where((F.col("hid") == hid) & (F.col("v") == F.lit(v))).isEmpty()

    def incident_hyperedges(self, v: Any) -> DataFrame:
        self._known(v)
        return self.incidence.where(F.col("v") == F.lit(v)).select("hid")

    def degrees(self) -> DataFrame:
        """(id, degree): hyperedges at each vertex."""
        n = self.incidence.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def _known(self, v: Any) -> None:
        if not self.contains_vertex(v):
            raise ValueError(f"vertex {v!r} is not in the hypergraph")

    def add_vertex(self, v: Any) -> Hypergraph:
        if self.contains_vertex(v):
            return self
        last = self.vertices.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
        new = self.vertices.sparkSession.createDataFrame([(v, last + 1)], self.vertices.select("id", "ord").schema)
        return Hypergraph(self.vertices.unionByName(new), self.incidence)

    def add_hyperedge(self, vs: list) -> tuple[Hypergraph, int]:
        """The hypergraph with one more hyperedge, and its hid."""
        vs = list(dict.fromkeys(vs))
        if not vs:
            raise ValueError("a hyperedge must have a vertex")
        hid = 1 + self.incidence.agg(F.coalesce(F.max("hid"), F.lit(-1))).first()[0]
        g = self
        for v in vs:
            g = g.add_vertex(v)
        rows = self.incidence.sparkSession.createDataFrame([(hid, v) for v in vs], self.incidence.schema)
        return Hypergraph(g.vertices, self.incidence.unionByName(rows)), hid

    def remove_vertex(self, v: Any) -> Hypergraph:
        """Without the vertex and every hyperedge at it."""
        gone = self.incidence.where(F.col("v") == F.lit(v)).select("hid")
        return Hypergraph(self.vertices.where(F.col("id") != F.lit(v)), self.incidence.join(gone, "hid", "left_anti"))

    def remove_hyperedge(self, hid: int) -> Hypergraph:
        return Hypergraph(self.vertices, self.incidence.where(F.col("hid") != hid))

    def clear(self) -> Hypergraph:
        return Hypergraph(self.vertices.limit(0), self.incidence.limit(0))

    def connected_components(self) -> DataFrame:
        """(id, component): component is the first vertex, by insertion, of the vertex's component.

        Each hyperedge is a star around its first vertex, which connects the same vertices as
        all its pairs do.
        """
        with_ord = self.incidence.join(self.vertices.select(F.col("id").alias("v"), "ord"), "v")
        firsts = with_ord.groupBy("hid").agg(F.min("ord").alias("first"))
        star = with_ord.join(firsts, "hid").where("ord <> first").select(F.col("ord").alias("u"), F.col("first").alias("v"))
        found = star_components(star)
        labels = cut(self.vertices.select("id", "ord").join(found.withColumnRenamed("node", "ord"), "ord", "left").withColumn("label", F.coalesce("component", "ord")))
        names = labels.where("ord = label").select("label", F.col("id").alias("component"))
        return labels.select("id", "label").join(names, "label").select("id", "component")

    def are_connected(self, a: Any, b: Any) -> bool:
        self._known(a)
        self._known(b)
        pair = self.connected_components().where(F.col("id").isin(a, b))
        return pair.select("component").distinct().count() == 1

    def to_clique_expansion(self) -> PropertyGraph:
        """The simple undirected graph of vertices that share a hyperedge; isolated ones stay."""
        v = self.vertices.select("id", "ord")
        members = self.incidence.join(v.withColumnsRenamed({"id": "v"}), "v")
        a = members.select("hid", F.col("v").alias("src"), F.col("ord").alias("oa"))
        b = members.select("hid", F.col("v").alias("dst"), F.col("ord").alias("ob"))
        pairs = a.join(b, "hid").where("oa < ob").select("src", "dst", "oa", "ob").distinct()
        rows = in_order(pairs, F.col("oa"), F.col("ob")).withColumn("eid", F.col("ord"))
        return PropertyGraph(v, rows.select("eid", "src", "dst", "ord"), False, False)

    def to_incidence_graph(self) -> PropertyGraph:
        """The bipartite graph of vertices and hyperedges; ids are (is_hyperedge, vertex, hyperedge_index)."""
        from .plans.supersteps import ranked

        kind = self.vertices.schema["id"].dataType
        index = cut(ranked(self.incidence.select("hid").distinct(), F.col("hid"), name="n"))
        n = self.vertices.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
        vertex = lambda c: F.struct(F.lit(False).alias("is_hyperedge"), F.col(c).alias("vertex"), F.lit(None).cast("int").alias("hyperedge_index"))
        edge = F.struct(F.lit(True).alias("is_hyperedge"), F.lit(None).cast(kind).alias("vertex"), F.col("n").cast("int").alias("hyperedge_index"))
        vertices = self.vertices.select(vertex("id").alias("id"), "ord").unionByName(index.select(edge.alias("id"), (F.col("n") + n).alias("ord")))
        rows = self.incidence.join(index, "hid").join(self.vertices.select(F.col("id").alias("v"), "ord"), "v")
        edges = in_order(rows.select(vertex("v").alias("src"), edge.alias("dst"), F.col("n"), F.col("ord").alias("o")), F.col("n"), F.col("o"))
        return PropertyGraph(vertices, edges.select(F.col("ord").alias("eid"), "src", "dst", "ord"), False, False)
