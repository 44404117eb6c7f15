"""Density, bipartition, transposition, closure, clustering, cliques and colouring."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, forests
from ..graph import PropertyGraph, first_by_key
from ..plans.lineage import cut, passing, store
from ..plans.supersteps import check
from . import connectivity, kernels

#: Edges from which triangles are found in stored blocks, in place of a join of edge pairs.
BLOCKED = 1_000_000
#: Neighbours up to which they are broadcast.
NEAR = 100_000


def density(g: PropertyGraph) -> float:
    """Edges over possible edges, 0 below two vertices; loops and parallels can take it over 1."""
    v, e = g.vertex_count(), g.edge_count()
    return 0.0 if v < 2 else (1 if g.directed else 2) * e / (v * (v - 1))


def degree_sequence(g: PropertyGraph) -> DataFrame:
    """(degree), greatest first."""
    return g.degrees().select("degree").orderBy(F.desc("degree"))


def find_bipartition(g: PropertyGraph, should_stop=None) -> DataFrame | None:
    """(id, side): 'left' holds the first vertex of each component; None if there is an odd cycle.

    Every vertex is taken twice, once for each parity, and every edge joins opposite parities.
    A vertex whose two copies meet in a component lies on an odd closed walk; else its even
    copy is in the component of the first vertex's even or odd copy, which gives its side.
    Tasks reduce their edges to those that span the copies; one task joins these.
    """
    check(should_stop)
    e = g.with_edges(g.edges.select("src", "dst")).edges_with_ords()
    found = cut(forests.parities(e.select(F.col("src_ord").alias("a"), F.col("dst_ord").alias("b"))))
    if not found.where("even = odd").isEmpty():
        return None
    side = F.when(F.coalesce("left", F.lit(True)), "left").otherwise("right")
    return g.vertices.select("id", "ord").join(found.withColumnRenamed("id", "ord"), "ord", "left").select("id", side.alias("side"))


def is_bipartite(g: PropertyGraph, should_stop=None) -> bool:
    return find_bipartition(g, should_stop) is not None


def transpose(g: PropertyGraph) -> PropertyGraph:
    g._directed()
    return g.with_edges(g.edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def closure_pairs(g: PropertyGraph, should_stop=None) -> DataFrame:
    """(src, dst): dst can be reached from src by at least one edge.

    Paths double in length each round, so the rounds grow with the logarithm of the longest
    shortest path; only pairs found in the last round are extended.
    """
    g._directed()
    known = fresh = cut(g.edges.select("src", "dst").distinct())
    while True:
        check(should_stop)
        a, b = known.select("src", F.col("dst").alias("m")), fresh.select(F.col("src").alias("m"), "dst")
        c, d = fresh.select("src", F.col("dst").alias("m")), known.select(F.col("src").alias("m"), "dst")
        longer = a.join(b, "m").select("src", "dst").unionByName(c.join(d, "m").select("src", "dst")).distinct()
        fresh = cut(longer.join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))


def transitive_closure(g: PropertyGraph, should_stop=None) -> PropertyGraph:
    """The graph with an edge for every non-empty path; vertices on cycles gain loops."""
    pairs = closure_pairs(g, should_stop)
    return PropertyGraph.from_dataframes(pairs, g.vertices.select("id", "ord"), True, False, order_by=["src", "dst"])


def transitive_reduction(g: PropertyGraph, should_stop=None) -> PropertyGraph:
    """The fewest edges of an acyclic graph with the same closure; of parallel edges the first."""
    g.require_acyclic()
    edges = first_by_key(g.edges, g.key_columns())
    closure = cut(closure_pairs(g, should_stop))
    over = edges.select("src", F.col("dst").alias("m")).join(closure.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst")
    return PropertyGraph(g.vertices, edges.join(over, ["src", "dst"], "left_anti").select(*edges.columns), True, False)


def triangles(g: PropertyGraph) -> DataFrame:
    """(a, b, c) each triangle once.

    Edges run from the end of smaller degree to the other, so no vertex opens more than
    about sqrt(2 E) of them, hubs included; two that leave a vertex are closed by an edge.
    """
    if _large(g):
        return _block_triangles(g)
    e = cut(g.skeleton())
    degree = e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    ranked = e.join(degree.withColumnsRenamed({"v": "a", "k": "ka"}), "a").join(degree.withColumnsRenamed({"v": "b", "k": "kb"}), "b")
    first = F.struct("ka", "a") < F.struct("kb", "b")
    turned = cut(ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedge = turned.select("u", F.col("v").alias("x")).join(turned.select("u", F.col("v").alias("y")), "u").where("x < y")
    return wedge.join(e.withColumnsRenamed({"a": "x", "b": "y"}), ["x", "y"]).select(F.col("u").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"))


def _block_triangles(g: PropertyGraph) -> DataFrame:
    kind = g.vertices.schema["id"].dataType.simpleString()

    def use(ids, found):
        for numbers in found:
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]) for x in numbers], ["a", "b", "c"])

    whole = blocks.Blocks(g.skeleton())
    t = store(whole.triangles(use, "a long, b long, c long"))
    whole.remove()
    return t.select(*[F.col(c).cast(kind).alias(c) for c in "abc"])


def _large(g: PropertyGraph) -> bool:
    """Whether triangles are found in blocks; ids that are no integers are joined."""
    return g.vertices.schema["id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") and g.edges.limit(BLOCKED + 1).count() > BLOCKED


def _links(g: PropertyGraph) -> DataFrame:
    """(id, k, links): distinct neighbours of each vertex and edges among them, loops and directions aside."""
    if _large(g):
        e = g.skeleton()
        with passing(e.sparkSession):
            k = cut(blocks.tally(e, ["a", "b"]))
            found = blocks.Blocks(e, k)
            t = cut(found.links())
            found.remove()
            rows = g.vertices.select("id").join(k, "id", "left").join(t, "id", "left")
            return cut(rows.select("id", F.coalesce("n", F.lit(0)).alias("k"), F.coalesce("links", F.lit(0)).alias("links")))
    k = g.skeleton().select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    t = triangles(g).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    rows = g.vertices.select("id").join(k, "id", "left").join(t, "id", "left")
    return rows.select("id", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("links", F.lit(0)).alias("links"))


def clustering_coefficients(g: PropertyGraph) -> DataFrame:
    """(id, coefficient): edges among a vertex's neighbours over the possible ones; 0 below two neighbours."""
    possible = F.col("k") * (F.col("k") - 1) / 2
    return _links(g).select("id", F.when(F.col("k") > 1, F.col("links") / possible).otherwise(0.0).alias("coefficient"))


def local_clustering_coefficient(g: PropertyGraph, v: Any) -> float:
    """The coefficient of one vertex, from its neighbours' edges alone."""
    g._known(v)
    e = g.skeleton()
    near = e.where((F.col("a") == F.lit(v)) | (F.col("b") == F.lit(v))).select(F.when(F.col("a") == F.lit(v), F.col("b")).otherwise(F.col("a")).alias("n"))
    k = near.count()
    if k < 2:
        return 0.0
    if k <= NEAR:
        near = F.broadcast(near)
    among = e.join(near.withColumnRenamed("n", "a"), "a", "left_semi").join(near.withColumnRenamed("n", "b"), "b", "left_semi")
    return among.count() / (k * (k - 1) / 2)


def average_clustering_coefficient(g: PropertyGraph) -> float:
    return clustering_coefficients(g).agg(F.avg("coefficient")).first()[0] or 0.0


def global_clustering_coefficient(g: PropertyGraph) -> float:
    """All links among neighbours over all pairs of neighbours."""
    row = _links(g).agg(F.sum("links").alias("l"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("p")).first()
    return float(row["l"]) / row["p"] if row["p"] else 0.0


def maximal_cliques(g: PropertyGraph) -> DataFrame:
    """(clique): every maximal clique as a sorted array; an isolated vertex is one.

    One kernel a root vertex over the edges among its neighbours; each clique has the root
    that is its smallest member.
    """
    e = g.skeleton() if _large(g) else cut(g.skeleton())
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    none = F.lit(None).cast(g.vertices.schema["id"].dataType)
    members = both.select(F.col("a").alias("root"), F.col("b").alias("a"), none.alias("b"))
    t = triangles(g)
    closed = t.select("a", "b", "c").unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    closed = closed.unionByName(t.select(F.col("c").alias("a"), F.col("a").alias("b"), F.col("b").alias("c")))
    rows = members.unionByName(closed.select(F.col("a").alias("root"), F.col("b").alias("a"), F.col("c").alias("b")))
    kind = g.vertices.schema["id"].dataType.simpleString()
    found = kernels.by_component(rows, ["root"], kernels.maximal_cliques, f"clique array<{kind}>")
    alone = g.vertices.select("id").join(both.select(F.col("a").alias("id")), "id", "left_anti")
    return found.unionByName(alone.select(F.array("id").alias("clique")))


def color_vertices(g: PropertyGraph, should_stop=None) -> DataFrame:
    """(id, color): DSatur by saturation, then distinct degree, then insertion; a loop is an error.

    Choices inside a component never depend on another, so components run in parallel.
    """
    if not g.edges.where("src = dst").isEmpty():
        raise ValueError("a graph with a loop can't be coloured")
    kind = g.vertices.schema["id"].dataType.simpleString()
    if g.edges.limit(BLOCKED + 1).count() > BLOCKED:
        return _packed_colours(g, should_stop)
    labels = cut(connectivity.component_ords(g, should_stop))
    none = F.lit(None).cast(g.vertices.schema["id"].dataType)
    pairs = g.skeleton().join(labels, F.col("a") == F.col("id")).select("id", "ord", "label", F.col("b").alias("other"))
    rows = labels.select("id", "ord", "label", none.alias("other")).unionByName(pairs)
    return kernels.by_component(rows, ["label"], kernels.saturation_colouring, f"id {kind}, color int")


def _packed_colours(g: PropertyGraph, should_stop=None) -> DataFrame:
    """The same colours of a large graph, in one task over four bytes an edge and direction."""
    check(should_stop)
    skeleton = g.skeleton()
    ends = g.with_edges(skeleton.select(F.col("a").alias("src"), F.col("b").alias("dst"))).edges_with_ords()
    found = blocks.Blocks(store(ends.select(F.col("src_ord").alias("a"), F.col("dst_ord").alias("b"))))

    def use(ords, starts, near):
        # numbers rise with degree, then order; the first shall have the greatest degree
        order = np.lexsort((np.arange(len(ords)), -np.diff(starts)))
        place = np.empty(len(ords), np.int32)
        place[order] = np.arange(len(ords), dtype=np.int32)
        sizes = np.diff(starts)[order]
        turned = np.zeros(len(ords) + 1, np.int64)
        np.cumsum(sizes, out=turned[1:])
        other = np.empty_like(near)
        for k, v in enumerate(order.tolist()):
            other[turned[k] : turned[k + 1]] = place[near[starts[v] : starts[v + 1]]]
        colours = kernels.saturation_colours(turned, other)
        for k in range(0, len(ords), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ords[order[k : k + 100_000]]), pa.array(colours[k : k + 100_000])], ["ord", "color"])

    colours = cut(found.whole(use, "ord long, color int"))
    found.remove()
    # a vertex without neighbours has the first colour
    return g.vertices.select("id", "ord").join(colours, "ord", "left").select("id", F.coalesce("color", F.lit(0)).alias("color"))


def color_count(colors: DataFrame) -> int:
    return colors.agg(F.countDistinct("color")).first()[0]
