"""One traversal per source vertex, in parallel over sources.

The graph goes to the workers as compressed adjacency, if it has a size that may be sent;
the sources are dealt over the partitions.  A larger graph takes the distributed form: all
sources' distances in one table, relaxed in supersteps.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import cut
from ..plans.supersteps import check

#: Arcs, and vertices, up to which a graph is sent to the workers, at 24 and 8 bytes each.
SENT_ARCS = 4_000_000


class Adjacency:
    """Neighbours and weights of vertex numbers 0..n-1."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None):
        order = np.argsort(src, kind="stable")
        self.n = n
        self.starts = np.searchsorted(src[order], np.arange(n + 1))
        self.dst = dst[order]
        self.weight = None if weight is None else weight[order]

    def lists(self) -> list[list[int]]:
        return [self.dst[a:b].tolist() for a, b in zip(self.starts, self.starts[1:])]

    def weighted(self) -> list[list[tuple]]:
        return [list(zip(self.dst[a:b].tolist(), self.weight[a:b].tolist())) for a, b in zip(self.starts, self.starts[1:])]


def hops(near: list[list[int]], source: int) -> dict[int, int]:
    """Vertex -> number of arcs from the source."""
    dist, queue = {source: 0}, deque([source])
    while queue:
        v = queue.popleft()
        for t in near[v]:
            if t not in dist:
                dist[t] = dist[v] + 1
                queue.append(t)
    return dist


def lengths(near: list[list[tuple]], source: int) -> dict[int, float]:
    """Vertex -> least sum of non-negative weights from the source."""
    dist, done, heap = {source: 0}, {}, [(0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done[v] = d
        for t, w in near[v]:
            if t not in done and (t not in dist or d + w < dist[t]):
                dist[t] = d + w
                heapq.heappush(heap, (d + w, t))
    return done


def dependencies(near: list, source: int, weighted: bool) -> dict[int, float]:
    """How much each vertex lies between the source and the others (Brandes)."""
    order: list[int] = []
    paths, before = {source: 1.0}, {source: []}
    if weighted:
        dist, done, heap = {source: 0}, set(), [(0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for t, w in near[v]:
                to = d + w
                if t not in dist or to < dist[t]:
                    dist[t], paths[t], before[t] = to, paths[v], [v]
                    heapq.heappush(heap, (to, t))
                elif to == dist[t] and t not in done:
                    paths[t] += paths[v]
                    before[t].append(v)
    else:
        dist, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for t in near[v]:
                if t not in dist:
                    dist[t], paths[t], before[t] = dist[v] + 1, 0.0, []
                    queue.append(t)
                if dist[t] == dist[v] + 1:
                    paths[t] += paths[v]
                    before[t].append(v)
    share = dict.fromkeys(order, 0.0)
    for v in reversed(order):
        for p in before[v]:
            share[p] += paths[p] / paths[v] * (1 + share[v])
    del share[source]
    return share


def numbered(g: PropertyGraph, weight: str | None) -> tuple[DataFrame, DataFrame]:
    """((id, n), arcs (s, t, w)) with dense vertex numbers in insertion order."""
    from ..plans.supersteps import ranked

    v = cut(ranked(g.vertices.select("id", "ord"), F.col("ord"), name="n").select("id", "n"))
    arcs = g.arcs()
    w = F.lit(1) if weight is None else F.col(weight)
    arcs = arcs.join(v.select(F.col("id").alias("src"), F.col("n").alias("s")), "src")
    arcs = arcs.join(v.select(F.col("id").alias("dst"), F.col("n").alias("t")), "dst")
    return v, cut(arcs.select("s", "t", w.alias("w")))


def per_source(v: DataFrame, arcs: DataFrame, weighted: bool, work: Callable, schema: str) -> DataFrame:
    """Runs ``work(near, sources, n)`` on batches of source numbers; it yields pandas frames."""
    n = v.count()
    rows = arcs.toPandas()  # at most SENT_ARCS, as the callers check
    kind = object if rows.w.dtype == object else (np.float64 if rows.w.dtype.kind == "f" else np.int64)
    graph = Adjacency(n, rows.s.to_numpy(), rows.t.to_numpy(), rows.w.to_numpy(dtype=kind) if weighted else None)
    sent = v.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = sent.value.weighted() if weighted else sent.value.lists()
        for batch in batches:
            yield from work(near, batch.n.tolist(), n)

    width = max(1, min(4 * v.sparkSession.sparkContext.defaultParallelism, n))
    return v.select("n").repartition(width).mapInPandas(run, schema)


def small_enough(v: DataFrame, arcs: DataFrame) -> bool:
    return max(arcs.count(), v.count()) <= SENT_ARCS


def distances(v: DataFrame, arcs: DataFrame, weighted: bool, should_stop=None) -> DataFrame:
    """(s, t, d): every pair's distance, from non-negative weights or hops."""
    kind = arcs.schema["w"].dataType.simpleString() if weighted else "int"
    if small_enough(v, arcs):

        def work(near, sources, n):
            for s in sources:
                d = lengths(near, s) if weighted else hops(near, s)
                yield pd.DataFrame({"s": s, "t": list(d), "d": list(d.values())})

        return per_source(v, arcs, weighted, work, f"s long, t long, d {_wide(kind)}")
    return relaxed(v.select(F.col("n").alias("s"), F.col("n").alias("t"), F.lit(0).cast(_wide(kind)).alias("d")), arcs, should_stop)


def relaxed(start: DataFrame, arcs: DataFrame, should_stop=None) -> DataFrame:
    """(s, t, d) from the starting rows by relaxing arcs in supersteps."""
    state = cut(start.withColumn("fresh", F.lit(True)))
    while True:
        check(should_stop)
        step = state.where("fresh").join(arcs.select(F.col("s").alias("via"), F.col("t").alias("next"), "w"), F.col("t") == F.col("via"))
        offers = step.groupBy("s", F.col("next").alias("t")).agg(F.min(F.col("d") + F.col("w")).alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("d").isNull() | (F.col("offer") < F.col("d")))
        joined = state.select("s", "t", "d").join(offers, ["s", "t"], "full")
        state = cut(joined.select("s", "t", F.when(better, F.col("offer")).otherwise(F.col("d")).alias("d"), better.alias("fresh")))
        if state.where("fresh").isEmpty():
            return state.select("s", "t", "d")


def _wide(kind: str) -> str:
    return {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}.get(kind, kind)


def summaries(v: DataFrame, arcs: DataFrame, weighted: bool, should_stop=None) -> DataFrame:
    """(s, reached, total, furthest) of each source, distances summed where they are found."""
    kind = _wide(arcs.schema["w"].dataType.simpleString()) if weighted else "bigint"
    if small_enough(v, arcs):

        def work(near, sources, n):
            rows = []
            for s in sources:
                d = (lengths(near, s) if weighted else hops(near, s)).values()
                rows.append((s, len(d), sum(d), max(d)))
            yield pd.DataFrame(rows, columns=["s", "reached", "total", "furthest"])

        return per_source(v, arcs, weighted, work, f"s long, reached long, total {kind}, furthest {kind}")
    pairs = distances(v, arcs, weighted, should_stop)
    return pairs.groupBy("s").agg(F.count(F.lit(1)).alias("reached"), F.sum("d").cast(kind).alias("total"), F.max("d").alias("furthest"))
