"""Lazy enumeration of results: rows are fetched partition by partition as the caller asks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row


def lazily(df: DataFrame, *order: str) -> Iterator[Row]:
    """The rows of ``df`` in order; a caller that stops early leaves later partitions unread."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    yield from rows.toLocalIterator()
