"""Joins to one row a key whose hot keys are never gathered in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys that are broadcast, at most.
SENT_KEYS = 100_000
#: Rows up to which a key is never hot.
COOL = 1_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` inner joined by ``key`` to ``table``, one row a key whose ``count`` is its number of rows.

    A key is hot if it has more than ``COOL`` rows and more than its share of all rows among
    ``SENT_KEYS``, so there are never more hot keys than that: their part of the table is
    broadcast and their rows stay where they are.  The others are joined by a shuffle.
    ``table`` should be stored, as it is read several times.  ``count`` is not in the result.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    limit = max(COOL, total // SENT_KEYS)
    hot = table.where(F.col(count) > limit).drop(count)
    if hot.isEmpty():
        return rows.join(table.drop(count), key)
    cool = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cool.join(table.where(F.col(count) <= limit).drop(count), key))
