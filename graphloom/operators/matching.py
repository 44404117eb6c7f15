"""Maximum bipartite matching."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import cut, release
from ..plans.supersteps import ranked
from . import connectivity, kernels, structure

#: Edges from which one task matches them all, four bytes each.
PACKED = 2_000_000


def maximum_bipartite_matching(g: PropertyGraph, should_stop=None) -> DataFrame:
    """Edges of a maximum matching; components run in parallel."""
    if g.directed:
        raise ValueError("a matching is one of an undirected graph")
    sides = structure.find_bipartition(g, should_stop)
    if sides is None:
        raise ValueError("the graph is not bipartite")
    left = cut(sides.where("side = 'left'").select("id"))
    if g.edges.limit(PACKED + 1).count() > PACKED:
        return _packed(g, sides)
    labels = connectivity.component_ords(g, should_stop).select("id", "label")
    rows = g.edges.select("eid", "src", "dst", "ord").join(left.withColumn("is_left", F.lit(True)), F.col("src") == F.col("id"), "left").drop("id")
    first = F.coalesce("is_left", F.lit(False))
    rows = rows.select("eid", "ord", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("left"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("right"))
    rows = rows.join(labels.withColumnRenamed("id", "left"), "left")
    chosen = kernels.by_component(rows, ["label"], kernels.layered_matching, "eid long")
    return g.edges.join(chosen, "eid", "left_semi")


def _packed(g: PropertyGraph, sides: DataFrame) -> DataFrame:
    """The matching of a large graph: both sides numbered, the smaller one's neighbours sent to a task as arrays."""
    sides = cut(sides.join(g.vertices.select("id", "ord"), "id"))
    release(g.edges.sparkSession)
    counts = {r["side"]: r["count"] for r in sides.groupBy("side").count().collect()}
    own = min(("left", "right"), key=lambda side: counts.get(side, 0))
    number = [ranked(sides.where(F.col("side") == side).select("id", "ord"), F.col("ord"), name="n").select("id", F.col("n").cast("int").alias("n")) for side in ("left", "right")]
    both = cut(number[0].withColumn("own", F.lit(own == "left")).unionByName(number[1].withColumn("own", F.lit(own == "right"))))
    e = g.edges.select("eid", "ord", "src", "dst")
    e = e.join(both.withColumnsRenamed({"id": "src", "n": "s", "own": "forth"}), "src").join(both.select(F.col("id").alias("dst"), F.col("n").alias("t")), "dst")
    e = e.select("eid", "ord", F.when(F.col("forth"), F.col("s")).otherwise(F.col("t")).alias("u"), F.when(F.col("forth"), F.col("t")).otherwise(F.col("s")).alias("v"))

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        if parts:
            u, v = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            heads = np.flatnonzero(np.diff(u, prepend=-1))
            for k in range(0, len(heads), 1_000):
                some = heads[k : k + 1_000]
                ends = [*heads[k + 1 : k + 1_001], len(u)][: len(some)]
                yield pa.RecordBatch.from_arrays([pa.array(u[some]), pa.array([v[a:b].tobytes() for a, b in zip(some, ends)], pa.binary())], ["u", "near"])

    def matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, sizes, near = [], [], []
        for batch in batches:
            us.append(batch.column(0).to_numpy())
            data = batch.column(1).to_pylist()
            sizes += [len(x) // 4 for x in data]
            near.append(np.frombuffer(b"".join(data), np.int32))
        if us:
            starts = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=starts[1:])
            us, near = np.concatenate(us), np.concatenate(near)
            mate = match(starts, near)
            found = np.flatnonzero(mate >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(us[found]), pa.array(mate[found])], ["u", "v"])

    pairs = e.select("u", "v").repartition("u").mapInArrow(together, "u int, near binary").repartition(1).mapInArrow(matched, "u int, v int")
    pairs = cut(pairs)
    chosen = e.join(F.broadcast(pairs) if pairs.count() <= structure.NEAR else pairs, ["u", "v"]).groupBy("u", "v").agg(F.min_by("eid", "ord").alias("eid"))
    chosen = cut(chosen.select("eid"))
    return g.edges.join(F.broadcast(chosen) if chosen.count() <= structure.NEAR else chosen, "eid", "left_semi")


def match(starts: np.ndarray, near: np.ndarray) -> np.ndarray:
    """A maximum matching: for each row of neighbours the one that it has, or -1; layered augmenting paths after a greedy start."""
    n, m = len(starts) - 1, int(near.max()) + 1
    mate, holder = np.full(n, -1, np.int32), np.full(m, -1, np.int32)
    for u in np.argsort(np.diff(starts), kind="stable"):
        own = near[starts[u] : starts[u + 1]]
        free = holder[own] < 0
        k = int(free.argmax())
        if free[k]:
            mate[u], holder[own[k]] = own[k], u
    while True:
        layer = np.full(n, -1, np.int32)
        front = np.flatnonzero(mate < 0)
        layer[front] = depth = 0
        roots, found = front, False
        while len(front) and not found:
            depth += 1
            later = []
            for u in front:
                w = holder[near[starts[u] : starts[u + 1]]]
                found = found or bool((w < 0).any())
                w = w[w >= 0]
                w = np.unique(w[layer[w] < 0])
                layer[w] = depth
                later.append(w)
            front = np.concatenate(later)
        if not found:
            return mate
        cursor = starts[:-1].copy()
        for root in roots.tolist():
            path: list[int] = [root]
            via: list[int] = []
            while path:
                u = path[-1]
                k, end = cursor[u], starts[u + 1]
                while k < end:
                    w = holder[near[k]]
                    if w < 0 or layer[w] == layer[u] + 1:
                        break
                    k += 1
                cursor[u] = k + 1
                if k >= end:
                    path.pop()
                    if via:
                        via.pop()
                elif w < 0:
                    for x, y in zip(path, [*via, near[k]]):
                        mate[x], holder[y] = y, x
                    path = []
                else:
                    path.append(int(w))
                    via.append(int(near[k]))
