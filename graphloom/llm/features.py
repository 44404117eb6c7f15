"""Hashed character n-grams of texts, and bounded samples of labelled rows to fit models on."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Rows whose n-gram counts are held densely at a time.
ROWS = 256
#: Classes beyond which a label column is taken for something else.
MAX_CLASSES = 1024
#: Rows of a sample, at most.
MOST_ROWS = 16_000
RESOLUTION = 1 << 40


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space if it is no letter; all code points have one."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, range(sys.maxunicode + 1))], dtype=np.uint32)


def codepoints(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def letters_of(codes: np.ndarray) -> np.ndarray:
    return letters()[codes]


def ngram_counts(codes: list[np.ndarray], orders: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of the hashed n-grams of each code sequence, (rows, dims)."""
    lengths = np.array([len(c) for c in codes])
    joined = np.concatenate(codes) if len(codes) else np.empty(0, "<u4")
    row = np.repeat(np.arange(len(codes), dtype=np.int64), lengths)
    out = np.zeros(len(codes) * dims, dtype=np.int64)
    h = np.zeros(len(joined), dtype=np.uint32)
    for n in range(1, max(orders) + 1):
        size = len(joined) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint32(0x01000193) + joined[n - 1 :].astype(np.uint32) + np.uint32(n)
        if n in orders:
            whole = row[:size] == row[n - 1 :]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            bucket = (mixed ^ (mixed >> np.uint32(12))) % np.uint32(dims)
            out += np.bincount((row[:size] * dims + bucket)[whole], minlength=len(out))
    return out.reshape(len(codes), dims)


def blocks(texts: list, rows: int = ROWS) -> Iterator[slice]:
    for a in range(0, len(texts), rows):
        yield slice(a, a + rows)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int
) -> tuple[DataFrame, dict]:
    """((id, label, text) of a bounded sample, class -> number of labelled ids).

    Every class is drawn by a hash of the id at the rate that gives ``per_class`` rows, or
    whole if it has no more; beyond ``MOST_ROWS`` rows in all, every class gets fewer, so each
    of up to ``MAX_CLASSES`` classes takes part (more are an error).  The draw does not depend
    on partitions.  Null ids, labels and texts are left out; of several labels of an id the
    greatest counts, of several texts the one with the least hash, so an id is one row.
    """
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    given = given.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    counts = {r["label"]: r["count"] for r in given.groupBy("label").count().limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"{label_col} has more than {MAX_CLASSES} classes")
    wanted = min(per_class, max(1, MOST_ROWS // max(1, len(counts))))
    rates = [F.struct(F.lit(label).alias("label"), F.lit(min(RESOLUTION, int(RESOLUTION * wanted / n) + 1)).alias("rate")) for label, n in counts.items()]
    draw = F.pmod(F.xxhash64("id"), F.lit(RESOLUTION))
    rate = F.map_from_entries(F.array(*rates))[F.col("label")] if rates else F.lit(0)
    chosen = F.broadcast(given.where(draw < rate))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(chosen, "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return sample.select("id", "label", F.col("t.text").alias("text")), counts


def collect_features(sample: DataFrame, encode) -> list[tuple]:
    """(id, label, features) of a bounded sample, sorted by id; ``encode`` gives bytes for each text."""
    kind = sample.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            for at in blocks(texts):
                features = pa.array(encode(texts[at]), pa.binary())
                rows = part.slice(at.start, len(features))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), features], ["id", "label", "features"])

    found = sample.mapInArrow(run, f"id long, label {kind}, features binary").collect()
    return sorted(((r["id"], r["label"], bytes(r["features"])) for r in found), key=lambda r: (r[0], r[2]))


def sparse_bytes(counts: np.ndarray) -> list[bytes]:
    """Rows of counts as (index, count) pairs of 32-bit integers."""
    return [np.stack((at := np.flatnonzero(c), c[at])).astype("<u4").tobytes() for c in counts]


def dense_rows(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), dtype=np.float32)
    for k, raw in enumerate(rows):
        at, n = np.frombuffer(raw, dtype="<u4").reshape(2, -1)
        out[k, at] = n
    return out
