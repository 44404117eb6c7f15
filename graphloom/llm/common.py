"""Shared plumbing of the corpus operators: tables, Arrow slices, sorted runs, stored files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_dir

#: Text bytes that a Python worker handles at a time.
SLICE_BYTES = 2 << 20
#: Hot keys that are broadcast, at most.
SENT_KEYS = 200_000
#: Parts in which a hot key is joined if there are more.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the corpus."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_slices(
    batches: Iterable[pa.RecordBatch], text: int | str, limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their text columns; a slice holds ``limit`` bytes, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        # a row belongs to the slice in which its first byte lies
        starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)[:-1])) // limit
        cuts = np.flatnonzero(np.diff(starts)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a), column.slice(a, b - a)


def text_slices(
    batches: Iterable[pa.RecordBatch], text: int | str, limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with their texts."""
    for part, column in column_slices(batches, text, limit):
        yield part, column.to_pylist()


def position_of(docs: DataFrame, name: str) -> int:
    """The place of a column, found as Spark finds it: by its exact name if there is one, else whatever the case."""
    own = [k for k, c in enumerate(docs.columns) if c == name]
    found = own or [k for k, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{name!r} names {len(found)} of the columns {docs.columns}")
    return found[0]


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of sorted batches cut where the keys change, with each run's first row.

    A run that ends a batch waits for the next batch, so no run is ever split; what is
    held is one batch and one run.
    """
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if held is not None:
            cols = {n: np.concatenate((held[n], v)) for n, v in cols.items()}
        heads = run_heads(cols, keys)
        last = heads[-1]
        held = {n: v[last:] for n, v in cols.items()}
        if last:
            yield {n: v[:last] for n, v in cols.items()}, heads[:-1]
    if held is not None:
        yield held, np.zeros(1, dtype=np.int64)


def run_heads(cols: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Rows at which a new run of equal keys begins."""
    changed = np.zeros(len(cols[keys[0]]), dtype=bool)
    changed[0] = True
    for k in keys:
        changed[1:] |= cols[k][1:] != cols[k][:-1]
    return np.flatnonzero(changed)


def split_hot(df: DataFrame, keys: list[str], spread, block: int) -> DataFrame:
    """``df`` with (own, bi, bj): a row's block and the pair of blocks within its key in which it is compared.

    Keys of up to ``block`` rows have the one pair (0, 0).  A larger key is dealt into
    blocks by ``spread`` and each row goes to every pair that holds its block, so all
    pairs of rows meet in some task and no task gets the whole key.  Keys are counted with
    partial aggregates.  The hot ones are told to the rows where they are, by a broadcast, if
    there are at most ``SENT_KEYS``; if more, by a join on the key and one of ``SALTS`` salts,
    for each of which the hot keys are repeated.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    hot = cut(counted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    if hot.count() <= SENT_KEYS:
        dealt = df.join(F.broadcast(hot), same, "left")
    else:
        salted = hot.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(spread, F.lit(1)), F.lit(SALTS)).cast("int")
        dealt = df.withColumn("_s", salt).join(salted, [*same, F.col("_s") == F.col("_t")], "left")
    dealt = dealt.withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(F.least(other, F.col("own")).alias("bi"), F.greatest(other, F.col("own")).alias("bj")),
    )
    cols = [*df.columns, "own"]
    return dealt.withColumn("own", own).select(*cols, F.explode(pairs).alias("_p")).select(*cols, "_p.bi", "_p.bj")


class Remembered:
    """What a worker has computed for words, in two generations of at most ``limit`` words and a slice's.

    When the younger is full it becomes the older, from which words that come again are
    taken back; so frequent words stay and memory has a bound.
    """

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, words: set) -> list:
        """The words that are not known; the others are in ``young`` after the call."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        absent = [w for w in words if w not in young]
        young.update((w, old[w]) for w in absent if w in old)
        return [w for w in absent if w not in old]


class Forest:
    """Union-find over the rows of one batch; ``labels`` are refreshed by the caller's request."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Joins the pairs; a pair that joins two trees is kept as an edge."""
        for a, b in zip(left.tolist(), right.tolist()):
            ra, rb = self.find(a), self.find(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
                self.edges.append((a, b))

    def labels(self) -> np.ndarray:
        """The root of each row."""
        lab = self.parent
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
        self.parent = lab
        return lab


# -- stored files ---------------------------------------------------------------------------


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parsed.path
    return pafs.FileSystem.from_uri(uri)


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder under the shared checkpoint folder."""
    uri = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
    return uri


def store(uri: str, write: Callable) -> int:
    """Writes a file under another name and renames it, so a lost attempt leaves no half file."""
    fs, path = filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        write(out)
    fs.move(part, path)
    return fs.get_file_info(path).size


def remove_dir(spark: SparkSession, uri: str) -> None:
    """Removes a folder, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_bucket(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def tokenizer_file(name: str) -> str:
    """A public vocabulary file by name; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
