"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over them, exact verification.

Words are runs of letters, digits and underscores, lower-cased; shingles are five words (of
a shorter text, all its words).  For each benchmark item every window of a document with the
item's number of words (a shorter document: the whole) is a candidate.  Its 64-bit SimHash
is looked up among the items of that size in an index of ``BLOCKS`` blocks: fingerprints that
differ in at most ``radius`` bits agree up to ``radius // BLOCKS`` bits in some block, and
each block's table lists the items within that distance of every block value, so the lookup
guarantees all items within the radius.  What it finds is verified by the exact weighted
Jaccard similarity of the shingle multisets, the sum of smaller counts over that of larger.

Windows that no threshold can admit are skipped before their fingerprint is taken: a window
of m shingles as similar as ``threshold`` t to an item shares at least 2tm/(1+t) shingles
with it, so at least that many of its shingles are some item's.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import position_of, text_slices

WORDS = re.compile(r"\w+")
SHINGLE = 5
THRESHOLD = 0.8
#: Bits that may differ; five standard deviations above the mean at similarity 0.8.
RADIUS = 24
BLOCKS = 4
WIDTH = 64 // BLOCKS
#: Items indexed at a time; each takes 32 KB of block tables in a worker.
SLICE_ITEMS = 1500
#: Words and shingles of a sieve, at most: about 150 MB in a worker.
SIEVE_ENTRIES = 2_000_000
#: Indexes that a worker keeps.
INDEXES = 1
_BUILT: dict[str, "BenchmarkIndex"] = {}


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit spreads over the output."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles of word ids; one of the whole if it is shorter."""
    width = min(width, len(ids))
    count = len(ids) - width + 1
    total = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        total = mix(total + ids[k : k + count].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return total


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def pack(ones: np.ndarray) -> np.ndarray:
    return np.packbits(ones, axis=-1, bitorder="little").view("<u8").reshape(-1)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    low = sum(min(n, b[x]) for x, n in a.items())
    return low / (sum(a.values()) + sum(b.values()) - low)


class SizeIndex:
    """The items of one number of words, by blocks of their fingerprints."""

    def __init__(self, items: list[int], fps: np.ndarray, radius: int):
        self.items, self.fps, self.radius = items, fps, radius
        near = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint64)) <= radius // BLOCKS
        values = np.arange(1 << WIDTH, dtype=np.uint64)
        self.tables = []
        for b in range(BLOCKS):
            block = (fps >> np.uint64(b * WIDTH)) & np.uint64((1 << WIDTH) - 1)
            rows = np.stack([near[(values ^ v).astype(np.int64)] for v in block], axis=1)
            self.tables.append(np.packbits(rows, axis=1))

    def lookup(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        hit = None
        for b, table in enumerate(self.tables):
            rows = table[((fps >> np.uint64(b * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)]
            hit = rows if hit is None else hit | rows
        window, item = np.nonzero(np.unpackbits(hit, axis=1, count=len(self.items)))
        close = np.bitwise_count(fps[window] ^ self.fps[item]) <= self.radius
        return window[close], item[close]


class Sieve:
    """The benchmark's words, sizes and shingles, which tell the windows that may hold an item."""

    def __init__(self, texts: Iterable[str], shingle: int, threshold: float):
        self.shingle, self.threshold = shingle, threshold
        self.vocabulary: dict[str, int] = {}
        self.sizes: set[int] = set()
        self.shingles = np.empty(0, np.uint64)
        self.add(texts)

    def add(self, texts: Iterable[str]) -> None:
        every = [self.shingles]
        for words in map(words_of, texts):
            if words:
                for x in words:
                    self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
                self.sizes.add(len(words))
                every.append(shingle_hashes(self.ids(words), self.shingle))
        self.shingles = np.unique(np.concatenate(every))

    def __len__(self) -> int:
        return len(self.vocabulary) + len(self.shingles)

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def windows(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(item size, starts of the windows that a threshold may admit, shingle hashes, shingles of a window)."""
        if not words or not self.sizes:
            return
        ids = self.ids(words)
        by_width: dict[int, tuple] = {}
        for size in sorted(self.sizes):
            # sizes below a shingle have their own, whole-window shingles
            width = min(self.shingle, size, len(words))
            if width not in by_width:
                by_width[width] = self._prepared(ids, width)
            hits, hashes = by_width[width]
            if hashes is None:
                continue
            m = min(size, len(words)) - width + 1
            inside = hits[m:] - hits[:-m]
            starts = np.flatnonzero(inside >= max(1, np.ceil(2 * self.threshold * m / (1 + self.threshold) - 1e-9) if len(words) >= size else 1))
            if len(starts):
                yield size, starts, hashes, m

    def admits(self, text: str | None) -> bool:
        """Whether some window of the text may hold an item."""
        return any(True for _ in self.windows(words_of(text)))

    def _prepared(self, ids: np.ndarray, width: int) -> tuple:
        """Running count of benchmark shingles, and all hashes if there is one."""
        hashes = shingle_hashes(ids, width) if ids.any() else np.empty(0, np.uint64)
        known = np.zeros(max(0, len(ids) - width + 1), dtype=bool)
        if len(hashes):
            # a shingle with a word that no item has is no item's
            runs = np.convolve(ids > 0, np.ones(width, dtype=np.int64), "valid") == width
            at = np.flatnonzero(runs)
            known[at] = self.shingles[np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)] == hashes[at]
        return np.concatenate(([0], np.cumsum(known))), (hashes if known.any() else None)


class BenchmarkIndex(Sieve):
    """What a worker knows of the benchmark: its words, shingles and fingerprints by size."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, threshold: float, radius: int):
        super().__init__([text for _, text in items], shingle, threshold)
        by_size: dict[int, list[int]] = {}
        fps, self.counts = {}, {}
        for i, text in items:
            if words := words_of(text):
                hashes = shingle_hashes(self.ids(words), shingle)
                fps[i] = pack(2 * bits_of(hashes).sum(axis=0, dtype=np.int64) > len(hashes))[0]
                by_size.setdefault(len(words), []).append(i)
                self.counts[i] = self.multiset(words)
        self.by_size = {n: SizeIndex(i, np.array([fps[k] for k in i], np.uint64), radius) for n, i in by_size.items()}

    def multiset(self, words: list[str]) -> Counter:
        k = min(self.shingle, len(words))
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))

    def matches(self, text: str | None) -> dict[int, tuple[float, int]]:
        """item -> (best similarity, first word of the first window that has it)."""
        words = words_of(text)
        found: dict[int, tuple[float, int]] = {}
        for size, starts, hashes, m in self.windows(words):
            index = self.by_size[size]
            window, item = index.lookup(pack(2 * self._sums(hashes, starts, m) > m))
            for w, k in zip(starts[window].tolist(), item.tolist()):
                i = index.items[k]
                score = similarity(self.multiset(words[w : w + size]), self.counts[i])
                if score >= self.threshold and score > found.get(i, (0.0, 0))[0]:
                    found[i] = (score, w)
        return found

    @staticmethod
    def _sums(hashes: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
        """For each start, how many of its m hashes have each bit."""
        out = np.empty((len(starts), 64), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(starts) > m) + 1
        for a, b in zip([0, *cuts], [*cuts, len(starts)]):
            low = starts[a]
            total = np.zeros((starts[b - 1] + m - low + 1, 64), dtype=np.int64)
            np.cumsum(bits_of(hashes[low : starts[b - 1] + m]), axis=0, out=total[1:])
            out[a:b] = total[starts[a:b] + m - low] - total[starts[a:b] - low]
        return out


def _parts(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's distinct items in the order of their ids, null ids first, so many at a time."""
    rows = benchmark.where(F.col(text_col).isNotNull())
    rows = rows.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).distinct().orderBy("i", "t")
    part: list[tuple[int | None, str]] = []
    for row in rows.toLocalIterator():
        part.append((row.i, row.t))
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def _indexed(items: list[tuple[int | None, str]], shingle: int, threshold: float, radius: int):
    """A function that gives a worker its index, built for the first of its tasks; items go by their positions, as ids may repeat."""
    texts = tuple(t for _, t in items)
    key = hashlib.sha256(repr((texts, shingle, threshold, radius)).encode("utf-8", "surrogatepass")).hexdigest()

    return lambda: _index_of(key, texts, shingle, threshold, radius)


def _index_of(key: str, texts: tuple[str, ...], shingle: int, threshold: float, radius: int) -> BenchmarkIndex:
    """The index of the texts, remembered by the worker."""
    if key not in _BUILT:
        while len(_BUILT) >= INDEXES:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = BenchmarkIndex(list(enumerate(texts)), shingle, threshold, radius)
    return _BUILT[key]


def _sieve_of(parts: list[list[tuple[int | None, str]]], shingle: int, threshold: float) -> Sieve | None:
    """A sieve of several slices, or None if one index does or the sieve would pass its bound."""
    sieve = Sieve([], shingle, threshold)
    for items in parts if len(parts) > 1 else []:
        sieve.add(t for _, t in items)
        if len(sieve) > SIEVE_ENTRIES:
            return None
    return sieve if len(parts) > 1 else None


def _sifted(docs: DataFrame, column: int, sieve: Sieve, admitted: bool) -> DataFrame:
    """The rows whose text the sieve admits, or the others."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, column):
            found = part.filter(pa.array([sent.value.admits(t) == admitted for t in texts]))
            if found.num_rows:
                yield found

    return docs.mapInArrow(run, docs.schema)


def best_by_id(matches: dict[int, tuple[float, int]], items: list[tuple[int | None, str]]) -> list[tuple[int | None, float, int]]:
    """(item id, similarity, first word), the best for each id: the most similar, of equal ones the first."""
    best: dict[int | None, tuple[float, int]] = {}
    for k, (s, w) in matches.items():
        i = items[k][0]
        if i not in best or (s, -w) > (best[i][0], -best[i][1]):
            best[i] = (s, w)
    return [(i, *best[i]) for i in sorted(best, key=lambda i: (i is not None, i or 0))]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
) -> DataFrame:
    """(id, item, similarity, first_word): the items found in each document, with the best window.

    Only documents that hold an item have rows.  The benchmark goes to the workers in slices
    of ``SLICE_ITEMS`` items, so what is sent has a bound whatever its size.  If there are
    several, one pass over the documents stores those with a window that shares enough
    shingles with all items together, and each slice's pass reads these only; a benchmark of
    more than ``SIEVE_ENTRIES`` words and shingles has a pass over all documents for each slice.  Null and empty texts and items without words match nothing.
    Every text of the benchmark counts: texts that share an id give one row, the best, and
    so do all whose id is null, with a null item.  Repeated documents are repeated; a null
    id stays.  Other columns are not looked at.
    """
    parts = list(_parts(benchmark, item_col, item_text_col, SLICE_ITEMS))
    # an id whose texts fall in two slices needs its best row found, which takes numbered documents
    shared = any(a[-1][0] == b[0][0] for a, b in zip(parts, parts[1:]))
    number = F.monotonically_increasing_id() if shared else F.lit(0).cast("long")
    source = docs.select(number.alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sieve = _sieve_of(parts, shingle, threshold)
    source = cut(_sifted(source, 2, sieve, True)) if sieve is not None else cut(source) if shared else source
    schema = "rid long, id long, item long, similarity double, first_word long"
    found = None
    for items in parts:
        build = _indexed(items, shingle, threshold, radius)

        def run(batches: Iterator[pa.RecordBatch], build=build, items=items) -> Iterator[pa.RecordBatch]:
            index = build()
            for part, texts in text_slices(batches, "text"):
                numbers, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [(n, d, *m) for n, d, t in zip(numbers, ids, texts) for m in best_by_id(index.matches(t), items)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["rid", "id", "item", "similarity", "first_word"])

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    if shared:
        best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back"))).alias("best")
        found = found.groupBy("rid", "id", "item").agg(best).select(
            "rid", "id", "item", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("first_word")
        )
    return found.drop("rid").withColumnsRenamed({"id": id_col, "item": item_col})


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    A benchmark of up to ``SLICE_ITEMS`` items takes one narrow pass.  A larger one is sifted
    as in ``contaminated``: the rows that no slice can match stay where they are, and the few
    others go through one slice after another.  All columns stay as they are, whatever their
    names, and rows with null or empty texts stay.  Every text of the benchmark counts,
    whatever its id.
    """
    column, clean = position_of(docs, text_col), None
    parts = list(_parts(benchmark, item_col, item_text_col, SLICE_ITEMS))
    sieve, kept = _sieve_of(parts, shingle, threshold), docs
    if sieve is not None:
        clean, kept = _sifted(docs, column, sieve, False), cut(_sifted(docs, column, sieve, True))
    for k, items in enumerate(parts):
        build = _indexed(items, shingle, threshold, radius)

        def run(batches: Iterator[pa.RecordBatch], build=build) -> Iterator[pa.RecordBatch]:
            index = build()
            for part, texts in text_slices(batches, column):
                found = part.filter(pa.array([not index.matches(t) for t in texts]))
                if found.num_rows:
                    yield found

        # stored after each slice, so a task has one worker and one index
        kept = kept.mapInArrow(run, docs.schema)
        kept = kept if k == len(parts) - 1 else cut(kept)
    return kept if clean is None else clean.union(kept)
