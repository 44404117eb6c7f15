"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .skew import join_counted

MAX_ROUNDS = 100
#: Edges up to which one task joins them at once, in place of rounds over all tasks.
AT_ONCE = 10_000


def star_components(edges: DataFrame, left: str = "u", right: str = "v", should_stop=None) -> DataFrame:
    """(node, component) for every node that touches an edge; component is the smallest node.

    Each round first hangs every larger neighbour of a node on the node's smallest
    neighbour, then every smaller one, until the edges form stars around the minima;
    the number of rounds grows with the logarithm of the largest component.  Minima are
    aggregated before the shuffle, and those of hubs are joined back by a broadcast of bounded
    size, so no hub is gathered in a task.
    Loops and null ends are ignored; an empty table gives an empty result.
    """
    u, v = F.col(left), F.col(right)
    stars = cut(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo"))
        .distinct()
    )
    seen = _digest(stars)
    kind = stars.schema["hi"].dataType.simpleString()
    if seen[0] <= AT_ONCE and kind in ("bigint", "int", "string"):
        return cut(stars.coalesce(1).mapInPandas(_joined, f"node {kind}, component {kind}"))
    for _ in range(MAX_ROUNDS):
        if should_stop is not None:
            should_stop()
        stars = cut(_small_star(_large_star(stars)))
        now = _digest(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    members = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    centres = stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.unionByName(centres)


def _joined(frames):
    """Components of all the edges by union-find, the smallest node naming each."""
    parent: dict = {}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for frame in frames:
        for a, b in zip(frame.hi, frame.lo):
            a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            parent[max(a, b)] = min(a, b)
    if parent:
        yield pd.DataFrame({"node": list(parent), "component": [find(a) for a in parent]})


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(
        stars.select(F.col("lo").alias("n"), F.col("hi").alias("m"))
    )
    least = cut(both.groupBy("n").agg(F.min("m").alias("low"), F.count(F.lit(1)).alias("size")))
    least = least.select("n", F.least("n", "low").alias("low"), "size")
    return join_counted(both, least, "n", "size").where("m > n").select(F.col("m").alias("hi"), F.col("low").alias("lo")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    stars = cut(stars)
    least = cut(stars.groupBy("hi").agg(F.min("lo").alias("low"), F.count(F.lit(1)).alias("size")))
    rest = join_counted(stars, least, "hi", "size").where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
    return least.select("hi", F.col("low").alias("lo")).unionByName(rest).distinct()


def _digest(stars: DataFrame) -> tuple:
    hashed = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    return tuple(stars.agg(F.count(F.lit(1)), F.sum(hashed)).first())
