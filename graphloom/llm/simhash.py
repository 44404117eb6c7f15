"""SimHash near-duplicate detection with pigeonring candidate filtering.

A text is lower-cased in A-Z, split into words at ASCII white space, and its four-word
shingles (with repeats) are hashed by XXH64 with seed 42.  A fingerprint bit is 1 if it
is set in over half of the hashes.  Two texts link when their fingerprints differ in at
most ``radius`` bits.

Candidates come from the pigeonring principle.  The 64 bits form a ring of ``radius + 1``
segments.  If two fingerprints differ in at most ``radius`` bits, there is a segment from
which every chain of l consecutive segments has at most ``l * radius / segments``
differences.  The first segment of such a chain is equal in both fingerprints, and of the
next ones, cut into parts, all but the budget's number are, so a pair meets under a key of
those equal bits; there the whole chain condition is checked before a pair is linked.
Inside a key only pairs of yet unconnected fingerprints are compared and only the edges
of a spanning forest leave the task, so a group of thousands of copies costs no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import star_components
from ..plans.lineage import cut
from ..plans.skew import join_counted
from .common import Forest, sorted_runs, split_hot, text_slices

BITS = 64
SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: (segments in the chain, parts of the segments after the first) of ever more selective keys.
KEY_PLANS = ((2, 2), (3, 3), (4, 5), (5, 6), (5, 8))
#: Chance partners of a fingerprint up to which a key plan is taken.
CHANCE_PARTNERS = 64
#: Fingerprints of a key that one task compares.
BLOCK = 2048


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of a text; zero without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long; null and empty texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, fp long")


def segment_masks(segments: int) -> list[int]:
    """The ring's segments, as masks."""
    bounds = [round(i * BITS / segments) for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]


def key_masks(radius: int, chain: int, parts: int) -> list[tuple[int, int]]:
    """(first segment, mask of the bits that are equal) under which every linked pair meets."""
    segments = radius + 1
    masks = segment_masks(segments)
    budget = chain * radius // segments
    keys = []
    for first in range(segments):
        tail = [masks[(first + k) % segments] for k in range(1, chain)]
        bits = [1 << b for m in tail for b in range(BITS) if m >> b & 1]
        bounds = [round(k * len(bits) / parts) for k in range(parts + 1)]
        pieces = [sum(bits[a:b]) for a, b in zip(bounds, bounds[1:])]
        for equal in combinations(pieces, parts - budget):
            keys.append((first, masks[first] | sum(equal)))
    return keys


def choose_keys(distinct: int, radius: int) -> list[tuple[int, int]]:
    """The first key plan under which a fingerprint has few partners by chance.

    Every plan finds all pairs; a larger corpus gets longer keys."""
    for chain, parts in KEY_PLANS:
        keys = key_masks(radius, min(chain, radius + 1), parts)
        if sum(distinct / 2.0 ** m.bit_count() for _, m in keys) <= CHANCE_PARTNERS:
            break
    return keys


def link_runs(cols: dict[str, np.ndarray], keys: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Edges of a forest that connects the linked fingerprints of each run."""
    segments = radius + 1
    ring = np.array(segment_masks(segments), dtype=np.uint64)
    first_of = np.array([f for f, _ in keys])
    budgets = [(c * radius) // segments for c in range(1, segments + 1)]
    k, key, fp = cols["k"], cols["key"], cols["fp"].view(np.uint64)
    bi, bj = cols["bi"], cols["bj"]
    forest = Forest(len(k))
    lab = forest.labels()
    left = np.arange(len(k) - 1)
    step = 1
    while True:
        left = left[: np.searchsorted(left, len(k) - step)]
        right = left + step
        same = (key[left] == key[right]) & (k[left] == k[right]) & (bi[left] == bi[right]) & (bj[left] == bj[right])
        left = left[same]
        if not len(left):
            return forest.edges
        apart = lab[left] != lab[left + step]
        a = left[apart]
        b = a + step
        differ, spent = fp[a] ^ fp[b], np.zeros(len(a), dtype=np.int64)
        first = first_of[k[a]]
        for c, most in enumerate(budgets):
            spent = spent + np.bitwise_count(differ & ring[(first + c) % segments])
            fits = spent <= most
            a, b, differ, spent, first = a[fits], b[fits], differ[fits], spent[fits], first[fits]
        if len(a):
            forest.link(a, b)
            lab = forest.labels()
        step += 1


def links(classes: DataFrame, radius: int = 4, distinct: int | None = None) -> DataFrame:
    """(u, v): edges that connect all fingerprints within ``radius``; classes are (node, fp), fp distinct."""
    keys = choose_keys(classes.count() if distinct is None else distinct, radius)

    def signed(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    exploded = classes.select(
        "node", "fp", F.explode(F.array(*[
            F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, (_, m) in enumerate(keys)
        ])).alias("at"),
    ).select("at.k", "at.key", "node", "fp")
    dealt = split_hot(exploded, ["k", "key"], "fp", BLOCK)
    order = ["k", "key", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, _ in sorted_runs(batches, order):
            edges = link_runs(cols, keys, radius)
            if edges:
                pairs = cols["node"][np.array(edges)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return dealt.repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of each row.

    component_id is the smallest id that links reach, the row's own included.  Rows of one
    fingerprint form a class, so exact copies are compared once.  Null and empty texts share
    fingerprint zero and link like any other.  A repeated row is repeated in the result; rows
    without an id link like any other and have their component's id, null if no row of the
    component has one.  Other columns, whatever their names, are not looked at.  An empty
    table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")))
    found = star_components(links(classes.select(F.col("fp").alias("node"), "fp"), radius))
    linked = cut(classes.join(found, F.col("fp") == F.col("node")).select("fp", "least", "component"))
    least = cut(linked.groupBy("component").agg(F.min("least").alias("of_all"), F.count(F.lit(1)).alias("members")))
    named = join_counted(linked, least, "component", "members").select(F.col("fp").alias("_fp"), "of_all", F.lit(True).alias("_linked"))
    reached = F.when(F.col("_linked"), F.col("of_all")).otherwise(F.col("least")).alias("component_id")
    final = cut(classes.join(named, F.col("fp") == F.col("_fp"), "left").select("fp", "size", reached))
    return join_counted(rows, final, "fp", "size").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest id.

    Rows without an id can't be told apart by it and stay; of repeated rows that share the
    smallest id and the text, one stays.
    """
    groups = near_duplicates(docs.select(id_col, text_col), id_col, text_col, radius)
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    known = docs.where(F.col(id_col).isNotNull())
    first = known.join(kept, F.col(id_col) == F.col("_kept")).withColumn("_text", F.xxhash64(text_col))
    return (
        first.dropDuplicates([id_col, "_text"]).drop("_kept", "_text").unionByName(docs.where(F.col(id_col).isNull()))
    )
