"""Seeded random and closed-form graphs.

Random pairs are decided by a hash of the pair and the seed, so a seed gives the same graph
on any number of partitions.  Vertices are 0..n-1.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators import kernels


def _vertices(spark: SparkSession, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("the number of vertices must not be negative")
    return spark.range(n).select("id", F.col("id").alias("ord"))


def _graph(spark: SparkSession, n: int, pairs: DataFrame, order: Column, directed: bool = False) -> PropertyGraph:
    rows = pairs.select(order.cast("long").alias("ord"), "src", "dst")
    return PropertyGraph(_vertices(spark, n), rows.select(F.col("ord").alias("eid"), "src", "dst", "ord"), directed, False)


def _pairs(spark: SparkSession, n: int, directed: bool) -> DataFrame:
    """All candidate pairs, made row by row from a range over the sources."""
    targets = F.sequence(F.lit(0), F.lit(n - 1)) if directed else F.sequence(F.col("src") + 1, F.lit(n - 1))
    rows = spark.range(n if directed else max(0, n - 1)).select(F.col("id").alias("src"))
    return rows.select("src", F.explode(targets.cast("array<long>")).alias("dst")).where("src <> dst")


def _position(n: int) -> Column:
    return F.col("src") * F.lit(n) + F.col("dst")


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int, directed: bool = False) -> PropertyGraph:
    """Each pair is an edge with probability p; no loops."""
    if not 0 <= p <= 1:
        raise ValueError("a probability must be in [0, 1]")
    u = F.shiftrightunsigned(F.xxhash64("src", "dst", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return _graph(spark, n, _pairs(spark, n, directed).where(u < F.lit(p)), _position(n), directed)


def complete(spark: SparkSession, n: int) -> PropertyGraph:
    return _graph(spark, n, _pairs(spark, n, False), _position(n))


def complete_bipartite(spark: SparkSession, left: int, right: int) -> PropertyGraph:
    targets = F.sequence(F.lit(left), F.lit(left + right - 1)).cast("array<long>")
    rows = spark.range(left if right else 0).select(F.col("id").alias("src"), F.explode(targets).alias("dst"))
    return _graph(spark, left + right, rows, _position(left + right))


def path(spark: SparkSession, n: int) -> PropertyGraph:
    return _graph(spark, n, spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), F.col("src"))


def cycle(spark: SparkSession, n: int) -> PropertyGraph:
    if n < 3:
        raise ValueError("a cycle has at least three vertices")
    return _graph(spark, n, spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")), F.col("src"))


def star(spark: SparkSession, leaves: int) -> PropertyGraph:
    return _graph(spark, leaves + 1, spark.range(leaves).select(F.lit(0).cast("long").alias("src"), (F.col("id") + 1).alias("dst")), F.col("dst"))


def grid(spark: SparkSession, width: int, height: int) -> PropertyGraph:
    """Vertices row by row, each joined to its right and lower neighbour."""
    cell = spark.range(width * height).select(F.col("id").alias("src"), (F.col("id") % max(1, width)).alias("x"), F.floor(F.col("id") / max(1, width)).alias("y"))
    right = cell.where(F.col("x") < width - 1).select("src", (F.col("src") + 1).alias("dst"))
    down = cell.where(F.col("y") < height - 1).select("src", (F.col("src") + width).alias("dst"))
    return _graph(spark, width * height, right.unionByName(down), _position(width * height))


def _sequential(spark: SparkSession, n: int, make) -> PropertyGraph:
    """Edges that depend on the ones before, made in one task."""
    rows = kernels.single(spark.range(1), lambda _: kernels.frame(make(), ["ord", "src", "dst"]), "ord long, src long, dst long")
    return _graph(spark, n, rows, F.col("ord"))


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int) -> PropertyGraph:
    """Preferential attachment: m (n - m) edges, connected and simple."""
    if not 1 <= m < n:
        raise ValueError("each new vertex needs between 1 and n - 1 edges")

    def make() -> list[tuple]:
        rng, ends, rows = random.Random(seed), [], []
        for v in range(m, n):
            if v == m:
                targets = set(range(m))
            else:
                targets = set()
                while len(targets) < m:
                    targets.add(rng.choice(ends))
            for t in sorted(targets):
                rows.append((len(rows), v, t))
                ends += [v, t]
        return rows

    return _sequential(spark, n, make)


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int) -> PropertyGraph:
    """A ring lattice of k nearest neighbours, each edge's far end moved with probability p."""
    if k % 2 or not 0 <= k < n or not 0 <= p <= 1:
        raise ValueError("k must be even and below n, p in [0, 1]")

    def make() -> list[tuple]:
        rng = random.Random(seed)
        edges = [(v, (v + d) % n) for d in range(1, k // 2 + 1) for v in range(n)]
        near = [set() for _ in range(n)]
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        for i, (a, b) in enumerate(edges):
            if rng.random() < p and len(near[a]) < n - 1:
                c = rng.randrange(n)
                while c == a or c in near[a]:
                    c = rng.randrange(n)
                near[a].remove(b)
                near[b].remove(a)
                near[a].add(c)
                near[c].add(a)
                edges[i] = (a, c)
        return [(i, a, b) for i, (a, b) in enumerate(edges)]

    return _sequential(spark, n, make)
