"""Minimum spanning forests."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.components import star_components
from ..plans.lineage import cut
from ..plans.supersteps import check
from . import kernels
from .connectivity import component_ords


class SpanningForestAlgorithm(Protocol):
    """A strategy for minimum spanning forests."""

    def find(self, g: PropertyGraph) -> DataFrame: ...


def minimum_spanning_forest(g: PropertyGraph, weight: str = "weight", should_stop=None) -> DataFrame:
    """The edges of the forest that picking edges by (weight, enumeration order) gives.

    Each round every tree takes its least edge to another tree under that total order, which
    admits no ties, so the rounds (the logarithm of the vertices) end in the very edges that
    a sorted scan with union-find would pick.  Negative weights are allowed.
    """
    if g.directed:
        raise ValueError("a spanning forest is one of an undirected graph")
    rows = g.edges_with_ords().where("src_ord <> dst_ord")
    rank = F.struct(F.col(weight).alias("w"), F.col("src_ord").alias("a"), F.col("ord").alias("b"), F.col("eid").alias("eid"))
    left = cut(rows.select("eid", rank.alias("rank"), F.col("src_ord").alias("cs"), F.col("dst_ord").alias("ct")))
    taken = None
    while not left.isEmpty():
        check(should_stop)
        ends = left.select(F.explode(F.array("cs", "ct")).alias("c"), "rank", "cs", "ct")
        best = cut(ends.groupBy("c").agg(F.min_by(F.struct("rank", "cs", "ct"), "rank").alias("e")).select("e.*").distinct())
        part = best.select("rank.eid")
        taken = part if taken is None else cut(taken.unionByName(part))
        merged = cut(star_components(best.select(F.col("cs").alias("u"), F.col("ct").alias("v"))))
        for end in ("cs", "ct"):
            moved = merged.select(F.col("node").alias(end), F.col("component").alias("_to"))
            left = left.join(moved, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        left = cut(left.where("cs <> ct"))
    if taken is None:
        return g.edges.limit(0)
    return g.edges.join(taken.distinct(), "eid", "left_semi")


class Kruskal:
    """Edges by weight, the enumeration order breaking ties."""

    def __init__(self, weight: str = "weight"):
        self.weight = weight

    def find(self, g: PropertyGraph, should_stop=None) -> DataFrame:
        return minimum_spanning_forest(g, self.weight, should_stop)


class Prim:
    """Trees grown one after another, each from its first vertex, by the least edge at the rim.

    Under a total order the least edge that leaves a tree is always one of the forest, so only
    the forest's edges, one less than the vertices, are grown over: rounds over all edges find
    them, then a task a tree, of bounded size, puts them in the order of growth.
    """

    def __init__(self, weight: str = "weight"):
        self.weight = weight

    def find(self, g: PropertyGraph, should_stop=None) -> DataFrame:
        """The forest's edges with ``tree``, the order of the tree's first vertex, and ``step``, 0 for its first edge."""
        forest = g.with_edges(cut(minimum_spanning_forest(g, self.weight, should_stop)))
        labels = component_ords(forest, should_stop).select(F.col("ord").alias("src_ord"), F.col("label").alias("tree"))
        rows = forest.edges_with_ords().join(labels, "src_ord").select("tree", "src_ord", "dst_ord", F.col(self.weight).alias("weight"), "ord", "eid")
        rows = cut(rows)
        steps = kernels.by_component(rows, ["tree"], kernels.grown, "eid long, step long").join(rows.select("eid", "tree"), "eid")
        return forest.edges.join(steps, "eid").select(*g.edges.columns, "tree", "step")
