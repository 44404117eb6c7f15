"""Driver-side loops over distributed state, and distributed ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Cancelled
from .lineage import cut


def check(should_stop: Callable[[], bool] | None) -> None:
    """Raises ``Cancelled`` if the caller wants to stop; called once a superstep."""
    if should_stop is not None and should_stop():
        raise Cancelled("stopped by the caller")


def ranked(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """``df`` with a dense 0-based rank by ``order``, without gathering it in one task.

    Rows are dealt by ranges of the order and numbered in each partition; the partitions'
    sizes, one number each, give the offsets.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())
    offsets, at = [], 0
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    base = df.sparkSession.createDataFrame(offsets, "p long, _at long")
    low = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(base), part == F.col("p")).withColumn(name, F.col("_at") + low).drop("_m", "_at", "p")


def reach(seeds: DataFrame, arcs: DataFrame, should_stop=None, max_depth: int | None = None) -> DataFrame:
    """(id, level) of what the seeds (id) reach along arcs (src, dst), level by level."""
    seen = cut(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        check(should_stop)
        depth += 1
        step = frontier.join(arcs, frontier.id == arcs.src).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen
