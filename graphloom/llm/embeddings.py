"""Near-duplicate vectors by randomly rotated binary codes, confidence bounds and exact recomputation.

Vectors are compared within a label (and dimension).  Two steps:

1. Candidates.  The sides of a seeded normal hyperplane on which two vectors at the
   threshold cosine c lie differ with probability p = acos(c) / pi.  A table's key is k
   sides, of hyperplanes drawn for that table alone, so two vectors agree on it with
   probability (1 - p)^k independently of the other tables; there are as many tables as it
   takes to meet in none of them with at most half of ``miss``.  A vector's code is the
   signs of its coordinates after seeded random rotations.  Vectors that meet and whose
   codes are within a radius that a binomial distance exceeds with at most a quarter of
   ``miss`` are candidates; a spanning forest of them leaves each task, and its components
   hold every linked pair.
2. Verification.  A vector's code is stored as bits, with its correction factor f, the sum
   over the rotations of <code(o), o>, and its spread e, the root of the sum of 1 - <code(o), o>^2.
   Within a component the inner product of a vector q and a coded vector o is estimated
   without bias by <code(o), q> / f; the error bound is ``SIGMAS`` * e / f / sqrt(d - 1).  A
   pair whose upper bound is below the threshold is dropped; any other is recomputed in double
   precision, and only what that finds at or above the threshold is a link.

Rows of equal label and vector are one class from the start, which counts as many links as it
has rows, so copies cost no pairs.  Hot buckets and components are dealt into pairs of blocks, so no task holds one whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import star_components
from ..plans.lineage import cut
from ..plans.skew import join_counted
from .common import Forest, sorted_runs, split_hot

COSINE = 0.98
MISS = 1e-7
#: Standard deviations to which estimates are trusted.
SIGMAS = 5.5
#: Bits of a code, at least.
CODE_BITS = 128
#: Vectors of one label that share a bucket by chance, about.
BUCKET = 256
BLOCK = 2048
#: Rows compared with a block at a time, and pairs recomputed at a time.
ROWS, PAIRS = 256, 65_536
#: What single precision may lose of an estimate.
ROUNDING = 1e-4


@lru_cache(maxsize=16)
def rotations(dim: int) -> np.ndarray:
    """Seeded random orthogonal matrices, stacked to at least ``CODE_BITS`` columns."""
    rng = np.random.default_rng(20_240_517 + dim)
    count = max(1, -(-CODE_BITS // dim))
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)], axis=1)


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign bits of the rotated vectors packed in bytes, correction factors, spreads)."""
    dim = units.shape[1]
    turned = units @ rotations(dim)
    # <code(o), o> for each rotation, the code being signs over the root of the dimension
    own = np.abs(turned).reshape(len(units), -1, dim).sum(axis=2) / math.sqrt(dim)
    return np.packbits(turned > 0, axis=1, bitorder="little"), own.sum(axis=1), np.sqrt(np.maximum(0.0, 1 - own**2).sum(axis=1))


def signs(code: list[bytes], dim: int) -> np.ndarray:
    """The codes as vectors, (rows, bits)."""
    raw = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
    bits = np.unpackbits(raw, axis=1, bitorder="little", count=rotations(dim).shape[1])
    return (2 * bits.astype(np.float32) - 1) / np.float32(math.sqrt(dim))


def tables_for(vectors: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits of a table's key, number of tables) for so many vectors of one label."""
    differ = math.acos(cosine) / math.pi
    bits = min(24, max(4, math.ceil(math.log2(max(1.0, vectors / BUCKET)))))
    meet = (1 - differ) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


@lru_cache(maxsize=4)
def planes(dim: int, bits: int, count: int) -> np.ndarray:
    """Seeded normal hyperplanes, each table's own, (tables, dim, bits)."""
    return np.random.default_rng(977 + dim).normal(size=(count, dim, bits))


def table_keys(units: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The key of each row in each table, (rows, tables)."""
    place = 1 << np.arange(bits)
    return np.stack([((units @ own) > 0) @ place for own in planes(units.shape[1], bits, count)], axis=1)


@lru_cache(maxsize=64)
def radius_for(width: int, cosine: float, miss: float) -> int:
    """The least distance that codes of ``width`` bits at the cosine exceed with at most ``miss`` probability, bits being independent."""
    differ = math.acos(cosine) / math.pi
    tail, r = 0.0, width
    while r > 0:
        tail += math.exp(math.lgamma(width + 1) - math.lgamma(r + 1) - math.lgamma(width - r + 1) + r * math.log(differ) + (width - r) * math.log1p(-differ))
        if tail > miss:
            break
        r -= 1
    return r


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(rid, id, label, dim, vector, code, factor, spread, same) with a row number and a digest of label and
    vector; dim 0 marks what links with nothing and has neither code nor digest."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("vector")
    )
    usable = (
        F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("vector", lambda x: x != 0.0), F.lit(False))
    )
    rows = rows.withColumn("dim", F.when(usable, F.size("vector")).otherwise(0))
    rows = rows.select("rid", "id", "label", "dim", F.when(F.col("dim") > 0, F.col("vector")).alias("vector"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            code: list[bytes | None] = [None] * len(dims)
            same: list[bytes | None] = [None] * len(dims)
            factor, spread = np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims[dims > 0]).tolist():
                at = np.flatnonzero(dims == dim)
                vectors, labels = stacked(batch.column("vector").take(pa.array(at)), dim), batch.column("label").take(pa.array(at)).to_pylist()
                packed, factor[at], spread[at] = codes(unit(vectors))
                for k, c, v, label in zip(at.tolist(), map(bytes, packed), vectors, labels):
                    code[k], same[k] = c, hashlib.blake2b(v.tobytes() + repr(label).encode(), digest_size=16).digest()
            columns = [pa.array(code, pa.binary()), pa.array(factor), pa.array(spread), pa.array(same, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "code", "factor", "spread", "same"])

    kind = rows.schema["label"].dataType.simpleString()
    return cut(rows.mapInArrow(coded, f"rid long, id long, label {kind}, dim int, vector array<double>, code binary, factor double, spread double, same binary"))


def _classes(rows: DataFrame) -> DataFrame:
    """One row for each distinct vector of a label, with its number of rows (size) and their least id; copies are
    counted by partial aggregates, so a group of them is never gathered and makes no pairs."""
    once = [F.first(c).alias(c) for c in ("label", "dim", "vector", "code", "factor", "spread")]
    found = rows.where("dim > 0").groupBy("same").agg(F.min("rid").alias("rid"), F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), *once)
    return cut(found)


def stacked(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.array(vectors.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, dim)


def matrix(cols: dict[str, np.ndarray], at, dim: int) -> np.ndarray:
    return np.concatenate(cols["vector"][at]).reshape(-1, dim).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    # the greatest component is divided out first, so squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _candidates(rows: DataFrame, cosine: float, miss: float) -> DataFrame:
    """(u, v) edges whose components hold all pairs at or above the threshold."""
    usable = rows.where("dim > 0")
    most = usable.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, count = tables_for(most, cosine, miss / 2)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                keys = table_keys(unit(stacked(batch.column("vector").take(pa.array(at)), dim)), bits, count)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rid").take(pa.array(np.repeat(at, count))),
                        batch.column("label").take(pa.array(np.repeat(at, count))),
                        pa.array(np.full(n * count, dim, dtype=np.int32)),
                        pa.array(np.tile(np.arange(count, dtype=np.int32), n)),
                        pa.array(keys.reshape(-1).astype(np.int64)),
                        batch.column("code").take(pa.array(np.repeat(at, count))),
                    ],
                    ["rid", "label", "dim", "t", "key", "code"],
                )

    kind = rows.schema["label"].dataType.simpleString()
    spread_rows = usable.mapInArrow(spread, f"rid long, label {kind}, dim int, t int, key long, code binary")
    keyed = spread_rows.select("rid", F.xxhash64("label", "dim", "t", "key").alias("bucket"), F.xxhash64("label", "dim").alias("own_label"), "code")
    dealt = split_hot(keyed, ["bucket", "own_label"], "rid", BLOCK)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, heads in sorted_runs(batches, ["own_label", "bucket", "bi", "bj"]):
            ends = np.append(heads[1:], len(cols["rid"]))
            run = np.repeat(np.arange(len(heads)), ends - heads)
            widths = np.array([len(c) for c in cols["code"]])
            code = np.zeros((len(widths), -(-int(widths.max()) // 8)), dtype=np.uint64)
            for w in np.unique(widths).tolist():
                at = np.flatnonzero(widths == w)
                raw = np.frombuffer(b"".join(cols["code"][at]), np.uint8).reshape(-1, w)
                code[at, : -(-w // 8)] = np.pad(raw, ((0, 0), (0, -w % 8))).view("<u8")
            radius = np.zeros(len(widths), dtype=np.int64)
            for w in np.unique(widths).tolist():
                radius[widths == w] = radius_for(8 * w, cosine, miss / 4)
            forest, left, step = Forest(len(run)), np.arange(len(run)), 1
            lab = forest.labels()
            while True:
                left = left[: np.searchsorted(left, len(run) - step)]
                left = left[run[left] == run[left + step]]
                if not len(left):
                    break
                a = left[lab[left] != lab[left + step]]
                near = np.bitwise_count(code[a] ^ code[a + step]).sum(axis=1) <= radius[a]
                if near.any():
                    forest.link(a[near], a[near] + step)
                    lab = forest.labels()
                step += 1
            if forest.edges:
                pairs = cols["rid"][np.array(forest.edges)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    order = ["own_label", "bucket", "bi", "bj"]
    return dealt.drop("own").repartition(*order).sortWithinPartitions(*order, "rid").mapInArrow(link, "u long, v long")


def verified_pairs(
    x: np.ndarray, code: np.ndarray, factor: np.ndarray, spread: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs between the rows ``left`` and ``right`` (``same``: each unordered pair once), some rows at a time."""
    dim = x.shape[1]
    norms = np.sqrt((x * x).sum(axis=1))
    turned = ((x[left] / norms[left, None]) @ rotations(dim)).astype(np.float32)
    bound = SIGMAS * spread[right] / factor[right] / math.sqrt(max(1, dim - 1)) + ROUNDING
    against = code[right].T
    for a in range(0, len(left), ROWS):
        estimate = (turned[a : a + ROWS] @ against) / factor[right]
        doubtful = estimate + bound >= cosine
        if same:
            doubtful &= right[None, :] > left[a : a + ROWS, None]
        i, j = np.nonzero(doubtful)
        u, v = left[a + i], right[j]
        linked = np.concatenate([np.einsum("ij,ij->i", x[u[k : k + PAIRS]], x[v[k : k + PAIRS]]) for k in range(0, len(u), PAIRS)] or [np.empty(0)])
        linked = linked / (norms[u] * norms[v]) >= cosine
        if linked.any():
            yield u[linked], v[linked]


def _verify(members: DataFrame, cosine: float) -> DataFrame:
    """(kind, a, b): kind 0 is a class and a number of rows that it links with, kind 1 an edge of a forest of links."""
    dealt = split_hot(members, ["component", "label", "dim"], "rid", BLOCK)
    order = ["component", "label", "dim", "bi", "bj"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, heads in sorted_runs(batches, order):
            rows: list[np.ndarray] = []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(cols["rid"])]):
                at = np.arange(a, b)
                x = matrix(cols, at, int(cols["dim"][a]))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                size = cols["size"][at].astype(float)
                own, bi, bj = cols["own"][at], cols["bi"][a], cols["bj"][a]
                left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
                n, forest = np.zeros(b - a, dtype=np.int64), Forest(b - a)
                code = signs(cols["code"][at].tolist(), x.shape[1])
                for u, v in verified_pairs(x, code, cols["factor"][at], cols["spread"][at], left, right, cosine, bi == bj):
                    n += (np.bincount(u, size[v], b - a) + np.bincount(v, size[u], b - a)).astype(np.int64)
                    lab = forest.labels()
                    apart = lab[u] != lab[v]
                    forest.link(u[apart], v[apart])
                rid = cols["rid"][at]
                linked = np.flatnonzero(n)
                if len(linked):
                    rows.append(np.stack((np.zeros(len(linked), np.int64), rid[linked], n[linked]), axis=1))
                if forest.edges:
                    e = rid[np.array(forest.edges)]
                    rows.append(np.column_stack((np.ones(len(e), np.int64), e)))
            if rows:
                out = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.T.copy()], ["kind", "a", "b"])

    return dealt.repartition(*order).sortWithinPartitions(*order, "rid").mapInArrow(check, "kind long, a long, b long")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    miss: float = MISS,
) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    n_links is how many other rows the row links with directly, component_id the smallest
    id that links reach, the own one included, and kept whether that is the own id.  Rows
    link if their labels are equal and not null and their cosine is at least ``cosine``.
    Vectors that are null, empty, zero, or hold a null or non-finite component link with
    nothing, nor do vectors of different lengths.  Repeated rows are rows of their own and
    link with each other; a null id takes part in links, never names a component, and its
    row is not kept.  Other columns are not looked at.
    """
    rows = _prepared(vectors, id_col, vector_col, label_col)
    classes = _classes(rows)
    groups = star_components(_candidates(classes, cosine, miss))
    members = classes.join(groups, F.col("rid") == F.col("node")).select("component", "label", "dim", "rid", "size", "vector", "code", "factor", "spread")
    checked = cut(_verify(members, cosine))
    counts = checked.where("kind = 0").groupBy(F.col("a").alias("rid")).agg(F.sum("b").alias("others"))
    roots = star_components(checked.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = cut(classes.select("rid", "least").join(roots.select(F.col("node").alias("rid"), F.col("component").alias("root")), "rid"))
    of_root = cut(named.groupBy("root").agg(F.min("least").alias("of_all"), F.count(F.lit(1)).alias("members")))
    linked = join_counted(named, of_root, "root", "members").select("rid", "of_all").join(counts, "rid")
    found = classes.select("rid", "same", "size", "least").join(linked, "rid", "left").select(
        "same",
        "size",
        (F.col("size") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("of_all", "least").alias("component"),
    )
    alone = rows.where("dim = 0").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    every = join_counted(rows.where("dim > 0").select("same", "id"), cut(found), "same", "size").select("id", "n_links", "component")
    return every.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
