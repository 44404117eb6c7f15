"""Degree, closeness, betweenness, PageRank, eigenvector and Katz centrality: (id, score)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NegativeWeightError
from ..functions import fanout
from ..graph import PropertyGraph
from ..plans.lineage import cut
from ..plans.supersteps import check


def degree_centrality(g: PropertyGraph) -> DataFrame:
    """Degree over V - 1, 0 if there is one vertex; loops and parallel edges can take it over 1."""
    n = g.vertex_count()
    score = F.col("degree") / F.lit(n - 1) if n > 1 else F.lit(0.0)
    return g.degrees().select("id", score.cast("double").alias("score"))


def closeness_centrality(g: PropertyGraph, weight: str | None = None, should_stop=None) -> DataFrame:
    """(r - 1)^2 / ((V - 1) * sum of distances) over the r vertices reached; 0 if that is nothing."""
    v, arcs = fanout.numbered(g, weight)
    n = v.count()
    if weight is not None and not arcs.where("w < 0").isEmpty():
        raise NegativeWeightError("distances need non-negative weights")
    others, total = F.col("reached") - 1, F.col("total").cast("double")
    score = F.when((others > 0) & (total > 0), others / F.lit(max(1, n - 1)) * others / total).otherwise(0.0)
    found = fanout.summaries(v, arcs, weight is not None, should_stop)
    return found.join(v, found.s == v.n).select("id", score.alias("score"))


def betweenness_centrality(g: PropertyGraph, weight: str | None = None, should_stop=None) -> DataFrame:
    """Shortest paths through each vertex between two others, each pair's sharing one; halved if undirected.

    Not normalised; parallel edges are paths of their own; weights must be positive everywhere.
    """
    v, arcs = fanout.numbered(g, weight)
    if weight is not None and not arcs.where("w <= 0 or w is null").isEmpty():
        raise NegativeWeightError("betweenness needs positive weights")
    weighted = weight is not None
    if fanout.small_enough(v, arcs):

        def work(near, sources, n):
            total: dict[int, float] = {}
            for s in sources:
                for t, x in fanout.dependencies(near, s, weighted).items():
                    if x:
                        total[t] = total.get(t, 0.0) + x
            yield pd.DataFrame({"n": list(total), "x": list(total.values())})

        parts = fanout.per_source(v, arcs, weighted, work, "n long, x double")
    else:
        parts = _distributed_dependencies(v, arcs, weighted, should_stop)
    sums = parts.groupBy("n").agg(F.sum("x").alias("x"))
    half = 1.0 if g.directed else 0.5
    return v.join(sums, "n", "left").select("id", (F.coalesce("x", F.lit(0.0)) * half).alias("score"))


def _distributed_dependencies(v: DataFrame, arcs: DataFrame, weighted: bool, should_stop) -> DataFrame:
    """(n, x) for graphs too large to send: counts of paths forward and shares back, by distance."""
    pairs = cut(fanout.distances(v, arcs, weighted, should_stop))
    a = pairs.select("s", F.col("t").alias("p"), F.col("d").alias("dp"))
    tight = a.join(arcs.select(F.col("s").alias("p"), F.col("t").alias("c"), "w"), "p")
    tight = cut(tight.join(pairs.select("s", F.col("t").alias("c"), F.col("d").alias("dc")), ["s", "c"]).where("dp + w = dc").select("s", "p", "c"))
    paths = frontier = cut(pairs.where("s = t").select("s", F.col("t").alias("n"), F.lit(1.0).alias("paths"), F.lit(0).alias("depth")))
    waiting = cut(tight.groupBy("s", F.col("c").alias("n")).agg(F.count(F.lit(1)).alias("missing")).withColumn("sum", F.lit(0.0)))
    depth = 0
    while not frontier.isEmpty():
        check(should_stop)
        depth += 1
        met = frontier.select("s", F.col("n").alias("p"), "paths").join(tight, ["s", "p"]).groupBy("s", F.col("c").alias("n"))
        met = met.agg(F.count(F.lit(1)).alias("k"), F.sum("paths").alias("more"))
        waiting = waiting.join(met, ["s", "n"], "left").select(
            "s", "n", (F.col("missing") - F.coalesce("k", F.lit(0))).alias("missing"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum")
        )
        waiting = cut(waiting)
        frontier = cut(waiting.where("missing = 0").select("s", "n", F.col("sum").alias("paths"), F.lit(depth).alias("depth")))
        waiting = waiting.where("missing > 0")
        paths = cut(paths.unionByName(frontier))
    share = cut(paths.withColumn("x", F.lit(0.0)))
    for level in range(depth, 0, -1):
        check(should_stop)
        down = share.where(F.col("depth") == level).select("s", F.col("n").alias("c"), F.col("paths").alias("pc"), "x").join(tight, ["s", "c"])
        up = down.join(paths.select("s", F.col("n").alias("p"), F.col("paths").alias("pp")), ["s", "p"])
        gained = up.groupBy("s", F.col("p").alias("n")).agg(F.sum(F.col("pp") / F.col("pc") * (1 + F.col("x"))).alias("more"))
        share = cut(share.join(gained, ["s", "n"], "left").select("s", "n", "paths", "depth", (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("x")))
    return share.where("s <> n").select("n", "x")


def _iterate(g: PropertyGraph, first: float, arcs: DataFrame, step, max_iterations: int, tolerance: float, should_stop) -> DataFrame:
    """(id, score) after ``step``s until the scores change by less than ``tolerance`` in sum.

    ``step`` gets the state (id, score, ...) and the incoming sums (id, got) and returns the
    new state with ``score`` and ``prev``.
    """
    state = cut(g.vertices.select("id", F.lit(first).alias("score")))
    for _ in range(max_iterations):
        check(should_stop)
        got = arcs.join(state.select(F.col("id").alias("src"), "score"), "src")
        got = got.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        state = cut(step(state.join(got, "id", "left").withColumn("got", F.coalesce("got", F.lit(0.0)))))
        if tolerance > 0 and (state.agg(F.sum(F.abs(F.col("score") - F.col("prev")))).first()[0] or 0.0) < tolerance:
            break
    return state.select("id", "score")


def _folded(g: PropertyGraph) -> DataFrame:
    """(src, dst, share): arcs with parallel ones added up."""
    return cut(g.arcs().groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("share")))


def pagerank(
    g: PropertyGraph, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-9, should_stop=None
) -> DataFrame:
    """Uniform teleport, dangling rank spread uniformly, a parallel edge carrying a share of its own.

    Stops when the total change falls below ``tolerance``; the last ranks are the result in
    any case.
    """
    g._directed()
    if not 0 <= damping <= 1 or max_iterations < 1:
        raise ValueError("damping must be in [0, 1] and max_iterations at least 1")
    n = g.vertex_count()
    if not n:
        return g.vertices.select("id", F.lit(0.0).alias("score"))
    out = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    arcs = cut(_folded(g).join(out, "src").select("src", "dst", (F.col("share") / F.col("out")).alias("share")))
    dangling = cut(g.vertices.select("id").join(out.select(F.col("src").alias("id")), "id", "left_anti"))
    sinks = dangling.withColumn("sink", F.lit(True))
    any_sink = not dangling.isEmpty()

    def step(rows: DataFrame) -> DataFrame:
        lost = rows.join(sinks, "id").agg(F.sum("score")).first()[0] if any_sink else None
        base = (1 - damping) / n + damping * (lost or 0.0) / n
        return rows.select("id", (F.lit(base) + damping * F.col("got")).alias("score"), F.col("score").alias("prev"))

    return _iterate(g, 1.0 / n, arcs, step, max_iterations, tolerance, should_stop)


def eigenvector_centrality(g: PropertyGraph, max_iterations: int = 100, tolerance: float = 1e-9, should_stop=None) -> DataFrame:
    """Power iteration on A + I from 1/V, scaled to length one each time; in-neighbours count."""
    if max_iterations < 1:
        raise ValueError("max_iterations must be at least 1")
    n = g.vertex_count()
    if not n:
        return g.vertices.select("id", F.lit(0.0).alias("score"))

    def step(rows: DataFrame) -> DataFrame:
        moved = cut(rows.select("id", (F.col("score") + F.col("got")).alias("score"), F.col("score").alias("prev")))
        norm = math.sqrt(moved.agg(F.sum(F.col("score") ** 2)).first()[0] or 0.0)
        return moved.withColumn("score", F.col("score") / (norm or 1.0))

    return _iterate(g, 1.0 / n, _folded(g), step, max_iterations, tolerance, should_stop)


def katz_centrality(
    g: PropertyGraph, alpha: float = 0.1, beta: float = 1.0, max_iterations: int = 100, tolerance: float = 1e-9, should_stop=None
) -> DataFrame:
    """x = beta + alpha * sum over in-neighbours, from 0, scaled to length one at the end."""
    if alpha <= 0 or max_iterations < 1:
        raise ValueError("alpha must be positive and max_iterations at least 1")

    def step(rows: DataFrame) -> DataFrame:
        return rows.select("id", (F.lit(float(beta)) + alpha * F.col("got")).alias("score"), F.col("score").alias("prev"))

    rows = _iterate(g, 0.0, _folded(g), step, max_iterations, tolerance, should_stop)
    norm = math.sqrt(rows.agg(F.sum(F.col("score") ** 2)).first()[0] or 0.0)
    return rows.withColumn("score", F.col("score") / (norm or 1.0))
