"""Property graphs as two DataFrames, and their containers' operations.

``vertices`` has (id, ord) and ``edges`` (eid, src, dst, ord) with an optional weight and any
attributes.  ``ord`` is the insertion order, which rules every order of results; it is
increasing but need not be dense.  Ids are any orderable, groupable type and never null.
Graphs are immutable: what would change one returns another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GraphCycleError
from .plans.lineage import cut

#: Least order of a vertex that only edges name: after every vertex that is given.
IMPLIED = 1 << 61


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with an increasing ``ord`` by the given columns, numbered within ranges."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())


def never_null(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} must not be null"))).otherwise(F.col(name))


class PropertyGraph:
    """A directed or undirected graph, simple or with parallel edges."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, directed: bool = True, multi: bool = False):
        self.vertices, self.edges, self.directed, self.multi = vertices, edges, directed, multi

    # -- making graphs ----------------------------------------------------------------------

    @classmethod
    def from_dataframes(
        cls,
        edges: DataFrame,
        vertices: DataFrame | None = None,
        directed: bool = True,
        multi: bool = False,
        order_by: Iterable[str] | None = None,
        identity: Callable[[Column], Column] | None = None,
    ) -> PropertyGraph:
        """A graph of edge rows (src, dst, ...) and vertex rows (id, ...).

        Rows without ``ord`` are ordered by ``order_by``, by default all columns.  Ends that
        ``vertices`` lacks are added, an edge's source first.  A simple graph keeps the first
        of equal edges, whatever their payload.  ``identity`` maps ids to what makes two of
        them equal (say ``F.lower``); the first spelling is kept in ``display``.
        """
        e = edges if "ord" in edges.columns else in_order(edges, *[F.col(c) for c in order_by or edges.columns])
        if "eid" not in e.columns:
            e = e.withColumn("eid", F.col("ord"))
        e = e.withColumns({"src": never_null("src"), "dst": never_null("dst"), "ord": F.col("ord").cast("long"), "eid": F.col("eid").cast("long")})
        v = None
        if vertices is not None:
            v = vertices if "ord" in vertices.columns else in_order(vertices, *[F.col(c) for c in vertices.columns])
            v = v.withColumns({"id": never_null("id"), "ord": F.col("ord").cast("long")})
        if identity is not None:
            e = e.withColumns({"_s": F.col("src"), "_t": F.col("dst"), "src": identity(F.col("src")), "dst": identity(F.col("dst"))})
            if v is not None:
                v = v.withColumns({"display": F.col("id"), "id": identity(F.col("id"))})
        spelt = identity is not None
        # vertices that were implied in an earlier graph are given here, with orders above IMPLIED
        last = F.lit(IMPLIED) if v is None else F.greatest(F.lit(IMPLIED), F.coalesce(v.agg(F.max("ord")).scalar(), F.lit(0)) + 1)
        ends = e.select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("id"), (2 * F.col("ord") + last).alias("ord"), *([F.col("_s").alias("display")] if spelt else [])),
                    F.struct(F.col("dst").alias("id"), (2 * F.col("ord") + 1 + last).alias("ord"), *([F.col("_t").alias("display")] if spelt else [])),
                )
            ).alias("x")
        ).select("x.*")
        named = ends if v is None else v.unionByName(ends, allowMissingColumns=True)
        v = first_by(named, ["id"], "ord")
        e = e.drop("_s", "_t")
        g = cls(v, e, directed, multi)
        return g if multi else cls(v, first_by_key(e, g.key_columns()), directed, multi)

    @classmethod
    def from_rows(cls, spark: SparkSession, edges: list, vertices: list = (), directed: bool = True, multi: bool = False) -> PropertyGraph:
        """A graph of (src, dst[, weight]) tuples in insertion order, and of vertex ids before them."""
        edges, vertices = list(edges), list(vertices)
        known = [x for row in edges for x in row[:2]] + vertices
        kind = spark.createDataFrame([(known[0] if known else 0,)], ["id"]).schema["id"].dataType.simpleString()
        fields = f"src {kind}, dst {kind}"
        if edges and len(edges[0]) > 2:
            weight = spark.createDataFrame([(edges[0][2],)], ["w"]).schema["w"].dataType.simpleString()
            fields += f", weight {weight}"
        e = spark.createDataFrame([(*row, k) for k, row in enumerate(edges)], f"{fields}, ord long")
        v = spark.createDataFrame([(x, k) for k, x in enumerate(vertices)], f"id {kind}, ord long")
        return cls.from_dataframes(e, v, directed, multi)

    def key_columns(self) -> list[Column]:
        """What makes two edges of a simple graph equal."""
        src, dst = F.col("src"), F.col("dst")
        return [src.alias("_a"), dst.alias("_b")] if self.directed else [F.least(src, dst).alias("_a"), F.greatest(src, dst).alias("_b")]

    def with_edges(self, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.vertices, edges, self.directed, self.multi)

    # -- views ------------------------------------------------------------------------------

    def arcs(self) -> DataFrame:
        """(src, dst, eid, ord, ...) in every direction an edge can be walked; a loop once."""
        if self.directed:
            return self.edges
        back = self.edges.where("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
        return self.edges.unionByName(back)

    def skeleton(self) -> DataFrame:
        """(a, b): the distinct unordered pairs of different neighbours, a < b."""
        pairs = self.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        # an undirected simple graph has each pair once
        return pairs.distinct() if self.directed or self.multi else pairs

    def scan_vertices(self) -> DataFrame:
        return self.vertices.orderBy("ord")

    def enumeration(self) -> list[Column]:
        """Order in which edges are enumerated, over ``edges_with_ords``: by source vertex, then insertion."""
        return [F.col("src_ord"), F.col("ord")]

    def edges_with_ords(self) -> DataFrame:
        """Edges with their ends' orders."""
        v = self.vertices.select("id", F.col("ord").alias("o"))
        with_src = self.edges.join(v.withColumnsRenamed({"id": "src", "o": "src_ord"}), "src")
        return with_src.join(v.withColumnsRenamed({"id": "dst", "o": "dst_ord"}), "dst")

    def scan_edges(self, matrix: bool = False) -> DataFrame:
        """Edges grouped by source vertex in vertex order, by insertion within.

        With ``matrix`` in the order of an adjacency matrix: by row and column, undirected
        edges in the upper triangle.
        """
        e = self.edges_with_ords()
        if not matrix:
            return e.orderBy(*self.enumeration()).select(*self.edges.columns)
        order = (F.col("src_ord"), F.col("dst_ord"))
        if not self.directed:
            order = (F.least(*order), F.greatest(*order))
        return e.orderBy(*order).select(*self.edges.columns)

    def as_read_only(self) -> PropertyGraph:
        """The graph itself: DataFrames can't be changed."""
        return self

    def freeze(self) -> PropertyGraph:
        """A copy that no longer depends on its sources."""
        return PropertyGraph(cut(self.vertices), cut(self.edges), self.directed, self.multi)

    # -- counts and membership --------------------------------------------------------------

    def vertex_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def contains_vertex(self, v: Any) -> bool:
        return not self.vertices.where(F.col("id") == F.lit(v)).isEmpty()

    def contains_vertices(self, ids: DataFrame) -> DataFrame:
        """The rows of ``ids`` (id) that are vertices."""
        return ids.join(self.vertices.select("id"), "id", "left_semi")

    def between(self, s: Any, t: Any) -> Column:
        forth = (F.col("src") == F.lit(s)) & (F.col("dst") == F.lit(t))
        return forth if self.directed else forth | ((F.col("src") == F.lit(t)) & (F.col("dst") == F.lit(s)))

    def contains_edge(self, s: Any, t: Any) -> bool:
        return not self.edges.where(self.between(s, t)).isEmpty()

    def contains_edges(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` (src, dst) that are edges, in either direction if undirected."""
        return pairs.join(self.arcs().select("src", "dst"), ["src", "dst"], "left_semi")

    def get_edges(self, s: Any, t: Any) -> DataFrame:
        """Every edge between two vertices."""
        return self.edges.where(self.between(s, t))

    def _known(self, v: Any) -> None:
        if not self.contains_vertex(v):
            raise ValueError(f"vertex {v!r} is not in the graph")

    def _directed(self) -> None:
        if not self.directed:
            raise ValueError("a directed graph is needed")

    # -- degrees ----------------------------------------------------------------------------

    def _counted(self, ends: DataFrame, name: str) -> DataFrame:
        n = ends.groupBy("id").agg(F.count(F.lit(1)).alias(name))
        return self.vertices.select("id").join(n, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def degrees(self) -> DataFrame:
        """(id, degree) of every vertex; a loop counts two."""
        return self._counted(self.edges.select(F.explode(F.array("src", "dst")).alias("id")), "degree")

    def out_degrees(self) -> DataFrame:
        self._directed()
        return self._counted(self.edges.select(F.col("src").alias("id")), "out_degree")

    def in_degrees(self) -> DataFrame:
        self._directed()
        return self._counted(self.edges.select(F.col("dst").alias("id")), "in_degree")

    def degree(self, v: Any) -> int:
        self._known(v)
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return ends.where(F.col("id") == F.lit(v)).count()

    def out_edges(self, v: Any) -> DataFrame:
        self._directed()
        self._known(v)
        return self.edges.where(F.col("src") == F.lit(v))

    def in_edges(self, v: Any) -> DataFrame:
        self._directed()
        self._known(v)
        return self.edges.where(F.col("dst") == F.lit(v))

    def adjacent_edges(self, v: Any) -> DataFrame:
        """Edges at a vertex, a loop once."""
        self._known(v)
        return self.edges.where((F.col("src") == F.lit(v)) | (F.col("dst") == F.lit(v)))

    # -- changes ----------------------------------------------------------------------------

    def _later(self, rows: DataFrame, present: DataFrame) -> DataFrame:
        """``rows`` ordered after all that is present."""
        last = present.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
        rows = rows if "ord" in rows.columns else in_order(rows, *[F.col(c) for c in rows.columns])
        return rows.withColumn("ord", F.col("ord") + F.lit(last + 1))

    def add_vertices(self, ids: DataFrame) -> PropertyGraph:
        """The graph with the rows of ``ids`` that it lacks."""
        rows = first_by(self._later(ids, self.vertices), ["id"], "ord")
        new = rows.join(self.vertices.select("id"), "id", "left_anti")
        return PropertyGraph(self.vertices.unionByName(new, allowMissingColumns=True), self.edges, self.directed, self.multi)

    def add_edges(self, rows: DataFrame) -> PropertyGraph:
        """The graph with more edges; on a simple graph an edge that exists already stays as it is."""
        new = self._later(rows, self.edges)
        new = new if "eid" in new.columns else new.withColumn("eid", F.col("ord"))
        edges = self.edges.unionByName(new, allowMissingColumns=True)
        return PropertyGraph.from_dataframes(edges, self.vertices, self.directed, self.multi)

    def add_edges_acyclic(self, rows: DataFrame) -> PropertyGraph:
        """The acyclic graph with the edges, in order, that close no cycle; loops never do.

        A batch that leaves the graph acyclic is taken whole; only another one is decided
        edge by edge, in one task of bounded size.
        """
        from .operators import kernels, traversal

        self._directed()
        grown = self.add_edges(rows.where("src <> dst"))
        if not traversal.has_cycle(grown):
            return grown
        old = self.edges.select("eid").withColumn("old", F.lit(True))
        marked = grown.edges.join(old, "eid", "left").select("eid", "src", "dst", "ord", F.coalesce("old", F.lit(False)).alias("old"))
        accepted = kernels.single(marked, kernels.accept_acyclic, "eid long")
        edges = grown.edges.join(accepted, "eid", "left_semi")
        return PropertyGraph.from_dataframes(edges, self.vertices, True, self.multi)

    def remove_vertices(self, ids: DataFrame) -> PropertyGraph:
        """The graph without the vertices and every edge at them."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
        edges = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*self.edges.columns)
        return PropertyGraph(self.vertices.join(gone, "id", "left_anti"), edges, self.directed, self.multi)

    def remove_edge(self, s: Any, t: Any, weight: Any = None, payload: dict | None = None) -> PropertyGraph:
        """The graph without one edge: the first between the two vertices.

        With a weight or payload the edge must have them and, as stored, run from s to t.
        """
        payload = dict(payload or {}) | ({"weight": weight} if weight is not None else {})
        fits = self.between(s, t)
        if payload:
            fits = (F.col("src") == F.lit(s)) & (F.col("dst") == F.lit(t))
            for k, x in payload.items():
                fits = fits & F.col(k).eqNullSafe(F.lit(x))
        first = self.edges.where(fits).agg(F.min("ord").alias("ord")).where("ord is not null")
        return self.with_edges(self.edges.join(F.broadcast(first), "ord", "left_anti").select(*self.edges.columns))

    def clear(self) -> PropertyGraph:
        return PropertyGraph(self.vertices.limit(0), self.edges.limit(0), self.directed, self.multi)

    def require_acyclic(self) -> None:
        from .operators import traversal

        self._directed()
        if traversal.has_cycle(self):
            raise GraphCycleError(traversal.find_cycle(self))

    def create_views(self, prefix: str = "") -> None:
        """Temporary views ``vertices`` and ``edges`` for Spark SQL."""
        self.vertices.createOrReplaceTempView(f"{prefix}vertices")
        self.edges.createOrReplaceTempView(f"{prefix}edges")


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; one partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def first_by_key(edges: DataFrame, key: list[Column]) -> DataFrame:
    best = edges.groupBy(*key).agg(F.min_by(F.struct(*edges.columns), "ord").alias("_r"))
    return best.select("_r.*")


class GraphBuilder:
    """Collects vertices and edges one by one, in order, and builds the graph."""

    def __init__(self, spark: SparkSession, directed: bool = True, multi: bool = False):
        self.spark, self.directed, self.multi = spark, directed, multi
        self._vertices: dict = {}
        self._edges: list[tuple] = []

    def add_vertex(self, v: Any) -> GraphBuilder:
        self._vertices.setdefault(v)
        return self

    def add_vertices(self, vs: Iterable) -> GraphBuilder:
        for v in vs:
            self.add_vertex(v)
        return self

    def add_edge(self, s: Any, t: Any, weight: Any = None) -> GraphBuilder:
        self.add_vertices((s, t))
        self._edges.append((s, t) if weight is None else (s, t, weight))
        return self

    def add_edges(self, rows: Iterable[tuple]) -> GraphBuilder:
        for row in rows:
            self.add_edge(*row)
        return self

    def build(self) -> PropertyGraph:
        if any(x is None for row in self._edges for x in row[:2]) or None in self._vertices:
            raise ValueError("a vertex must not be null")
        return PropertyGraph.from_rows(self.spark, self._edges, list(self._vertices), self.directed, self.multi)


def directed(spark: SparkSession, multi: bool = False) -> GraphBuilder:
    return GraphBuilder(spark, True, multi)


def undirected(spark: SparkSession, multi: bool = False) -> GraphBuilder:
    return GraphBuilder(spark, False, multi)
