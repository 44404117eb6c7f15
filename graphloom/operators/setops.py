"""Subgraph, union and complement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, first_by, first_by_key


def subgraph(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """The graph induced by the rows of ``ids`` (id); unknown ids are ignored.

    Vertices come in the selection's order if it has an ``ord``, else as in the graph.
    """
    chosen = first_by(ids.select("id", "ord"), ["id"], "ord") if "ord" in ids.columns else ids.select("id").distinct()
    kept = g.vertices.join(chosen.select("id"), "id", "left_semi")
    if "ord" in ids.columns:
        kept = kept.drop("ord").join(chosen, "id").select(*g.vertices.columns)
    ends = kept.select("id")
    edges = g.edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph(kept, edges.select(*g.edges.columns), g.directed, g.multi)


def union(first: PropertyGraph, second: PropertyGraph) -> PropertyGraph:
    """Both graphs' vertices and edges, the first's before the second's; a simple graph keeps the first of equal edges."""
    if first.directed != second.directed:
        raise ValueError("a directed and an undirected graph have no union")

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of a, then of b, in each one's order."""
        last = a.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
        return a.unionByName(b.withColumn("ord", F.col("ord") + F.lit(last + 1)), allowMissingColumns=True)

    vertices = first_by(both(_small_ords(first.vertices), _small_ords(second.vertices)), ["id"], "ord")
    edges = both(first.edges, second.edges).withColumn("eid", F.col("ord"))
    return PropertyGraph(vertices, edges if first.multi else first_by_key(edges, first.key_columns()), first.directed, first.multi)


def _small_ords(vertices: DataFrame) -> DataFrame:
    """The same order by smaller numbers, so that two orders can follow each other."""
    from ..plans.supersteps import ranked

    return ranked(vertices.withColumnRenamed("ord", "_o"), F.col("_o"), name="ord").drop("_o")


def complement(g: PropertyGraph) -> PropertyGraph:
    """The simple graph of all pairs of different vertices that are not adjacent.

    The result is quadratic by definition; pairs are made partition by partition and those
    that are edges are anti-joined away.
    """
    if g.multi:
        raise ValueError("a graph with parallel edges has no complement")
    a = g.vertices.select(F.col("id").alias("src"), F.col("ord").alias("a"))
    b = g.vertices.select(F.col("id").alias("dst"), F.col("ord").alias("b"))
    pairs = a.join(b, F.col("a") != F.col("b") if g.directed else F.col("a") < F.col("b"))
    left = pairs.join(g.arcs().select("src", "dst"), ["src", "dst"], "left_anti")
    rows = left.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("ord", F.monotonically_increasing_id())
    return PropertyGraph(g.vertices, rows.select(F.col("ord").alias("eid"), "src", "dst", "ord"), g.directed, False)
