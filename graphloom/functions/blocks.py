"""Adjacency in blocks of the shared folder: triangles without a row for each pair of a vertex's edges.

Vertices are numbered by (degree, id), and each edge is kept at its lower end, so that none
keeps more than about sqrt(2 E) of them.  The blocks are written once, four bytes an edge; a
task takes one of them and reads the later ones in turn.  Only packed edges and counts are
shuffled.  Ids are integers; a worker holds 12 bytes a vertex, one block and its marks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, passing, remove, shared_dir
from ..plans.supersteps import ranked

#: Edge ends in a block, about; edges that are packed together; wedges that are looked at together.
BLOCK_ENDS, PACKED, WEDGES = 4_000_000, 1_000_000, 500_000
#: Vertices whose neighbours are marked together: the bits of a mark.
BITS = 64
#: Ends that are counted together.
TALLIED = 4_000_000


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), uri.removeprefix("file:")) if uri.startswith(("/", "file:/")) else pafs.FileSystem.from_uri(uri)


def _write(uri: str, *arrays: np.ndarray) -> None:
    """A file of the arrays' bytes, under another name until it is whole."""
    fs, path = _open(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        for a in arrays:
            out.write(a.tobytes())
    fs.move(part, path)


def _read(uri: str) -> pa.Buffer:
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def _longs(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def tally(df: DataFrame, names: list[str]) -> DataFrame:
    """(id, n): how often each integer occurs in the columns; counted in a few tasks before the shuffle."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ns, held, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            new, n = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate([ids, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            total[at[: len(ids)]] += ns
            total[at[len(ids) :]] += n
            return both, total

        for batch in batches:
            for c in batch.columns:
                held.append(_longs(c))
                size += len(c)
            if size >= TALLIED:
                ids, ns = merged()
                held, size = [], 0
        if held:
            ids, ns = merged()
        for k in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(ns[k : k + 100_000])], ["id", "n"])

    few = df.select(*names).coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism))
    return few.mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Blocks:
    """The edges (a, b) of a simple undirected graph, a and b different integers, each pair once."""

    def __init__(self, edges: DataFrame, degree: DataFrame | None = None):
        self.spark = edges.sparkSession
        self.uri = f"{shared_dir(self.spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
        uri = self.uri
        fs_made = lambda: _open(uri)[0].create_dir(_open(uri)[1], recursive=True)
        degree = tally(edges, ["a", "b"]) if degree is None else degree
        numbered = cut(ranked(degree, F.col("n"), F.col("id")))
        self.bounds = bounds = _bounds(numbered.groupBy("n").count().orderBy("n").collect())
        self.count = len(bounds) - 1

        def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(_longs(b.column(0)), _longs(b.column(1)).astype(np.int32)) for b in batches]
            ids, pos = (np.concatenate(x) if x else np.empty(0) for x in (zip(*parts) if parts else ((), ())))
            order = np.argsort(ids, kind="stable")
            fs_made()
            _write(f"{uri}/names", ids[order].astype(np.int64), pos[order].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64())], ["n"])

        numbered.select("id", "pos").coalesce(1).mapInArrow(listed, "n long").collect()

        def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, pos = names(uri)
            held, size = [], 0

            def rows():
                a, b = (np.concatenate(x) for x in zip(*held))
                a, b = pos[np.searchsorted(ids, a)], pos[np.searchsorted(ids, b)]
                low, high = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((high, low))
                low, high = low[order], high[order]
                ends = np.searchsorted(low, bounds)
                found = [(k, ends[k], ends[k + 1]) for k in range(len(bounds) - 1) if ends[k] < ends[k + 1]]
                data = [np.diff(low[s:e], prepend=np.int32(0)).tobytes() + high[s:e].tobytes() for _, s, e in found]
                return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], pa.int32()), pa.array(data, pa.binary())], ["block", "arcs"])

            for batch in batches:
                held.append((_longs(batch.column(0)), _longs(batch.column(1))))
                size += len(batch)
                if size >= PACKED:
                    yield rows()
                    held, size = [], 0
            if size:
                yield rows()

        def written(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf.block.iloc[0])
            low, high = [], []
            for data in pdf.arcs:
                both = np.frombuffer(data, np.int32)
                low.append(np.cumsum(both[: len(both) // 2], dtype=np.int32))
                high.append(both[len(both) // 2 :])
            low, high = np.concatenate(low), np.concatenate(high)
            order = np.lexsort((high, low))
            starts = np.searchsorted(low[order], np.arange(bounds[k], bounds[k + 1] + 1)).astype(np.int32)
            _write(f"{uri}/{k}", starts, high[order])
            return pd.DataFrame({"block": [k], "arcs": [len(low)]})

        with passing(self.spark):
            rows = edges.select("a", "b").mapInArrow(packed, "block int, arcs binary")
            self.present = sorted(r["block"] for r in rows.groupBy("block").applyInPandas(written, "block int, arcs long").collect())

    def triangles(self, use: Callable, schema: str) -> DataFrame:
        """Rows that ``use`` makes of each block's triangles: of (n, ids by number, frames of u < v < w numbers)."""
        uri, bounds, present = self.uri, self.bounds, self.present

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    ids, pos = names(uri)
                    by_number = np.empty_like(ids)
                    by_number[pos] = ids
                    del ids, pos
                    yield from use(by_number, _closed(uri, bounds, present, present[k]))

        return self.spark.range(0, len(present), 1, max(1, len(present))).mapInArrow(run, schema)

    def whole(self, use: Callable, schema: str) -> DataFrame:
        """Rows that ``use`` makes in one task of (ids by number, starts, neighbours): all edges in both directions, four bytes each."""
        uri, bounds, present = self.uri, self.bounds, self.present

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                ids, pos = names(uri)
                by_number = np.empty_like(ids)
                by_number[pos] = ids
                del ids, pos
                yield from use(by_number, *_both_ways(uri, bounds, present))

        return self.spark.range(0, 1, 1, 1).mapInArrow(run, schema)

    def links(self) -> DataFrame:
        """(id, links): triangles at each vertex that has any."""

        def use(ids: np.ndarray, found) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(ids), np.int64)
            for u, v, w in found:
                for x in (u, v, w):
                    np.add.at(total, x, 1)
            at = np.flatnonzero(total)
            for k in range(0, len(at), 100_000):
                part = at[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(total[part])], ["id", "links"])

        return self.triangles(use, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))

    def remove(self) -> None:
        remove(self.spark, self.uri)


def names(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids in ascending order and their numbers."""
    data = _read(f"{uri}/names")
    n = data.size // 12
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int32, n, 8 * n)


def _bounds(degrees: list) -> np.ndarray:
    """First numbers of the blocks, and the number of vertices; ends of ``BLOCK_ENDS`` edges or a little more in each."""
    first, at, room = [0], 0, BLOCK_ENDS
    for n, count in degrees:
        left = count
        while left:
            take = min(left, max(1, -(-room // n)))
            at, left, room = at + take, left - take, room - take * n
            if room <= 0:
                first.append(at)
                room = BLOCK_ENDS
    return np.array(first if first[-1] == at else [*first, at], np.int64)


def _block(uri: str, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, width = _read(f"{uri}/{k}"), int(bounds[k + 1] - bounds[k]) + 1
    return np.frombuffer(data, np.int32, width), np.frombuffer(data, np.int32, data.size // 4 - width, 4 * width)


def _closed(uri: str, bounds: np.ndarray, present: list[int], own: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, w) of the triangles whose lowest number is in the block."""
    starts, targets = _block(uri, bounds, own)
    base, width = int(bounds[own]), len(starts) - 1
    sources = np.repeat(np.arange(width, dtype=np.int32), np.diff(starts))
    marks = np.zeros(int(bounds[-1]), np.uint64)
    bit = np.left_shift(np.uint64(1), (sources % BITS).astype(np.uint64))
    for k in present:
        if k < own:
            continue
        near, far = (starts, targets) if k == own else _block(uri, bounds, k)
        into = np.flatnonzero((targets >= bounds[k]) & (targets < bounds[k + 1]))
        if not len(into):
            continue
        cuts = np.searchsorted(sources[into], np.arange(0, width + BITS, BITS))
        for c in range(len(cuts) - 1):
            arcs = into[cuts[c] : cuts[c + 1]]
            if not len(arcs):
                continue
            here = slice(starts[c * BITS], starts[min(width, (c + 1) * BITS)])
            np.bitwise_or.at(marks, targets[here], bit[here])
            v = targets[arcs] - bounds[k]
            low = near[v]
            sizes = (near[v + 1] - low).astype(np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < len(arcs):
                # so many arcs that their wedges fit, one at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WEDGES, "right")))
                n, done = sizes[at:to], ends[at - 1] if at else 0
                total = int(ends[to - 1] - done)
                if total:
                    w = far[np.arange(total) + np.repeat(low[at:to] - (ends[at:to] - n - done), n)]
                    hit = np.flatnonzero(marks[w] & np.repeat(bit[arcs[at:to]], n))
                    if len(hit):
                        of = arcs[at + np.searchsorted(ends[at:to] - done, hit, "right")]
                        yield sources[of] + base, targets[of], w[hit]
                at = to
            marks[targets[here]] = 0


def _both_ways(uri: str, bounds: np.ndarray, present: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, neighbours) of all vertices, filled block by block."""
    n = int(bounds[-1])
    sizes = np.zeros(n, np.int64)
    for k in present:
        starts, targets = _block(uri, bounds, k)
        sizes[bounds[k] : bounds[k + 1]] += np.diff(starts)
        sizes += np.bincount(targets, minlength=n)
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    near, at = np.empty(int(ends[-1]), np.int32), ends[:-1].copy()
    for k in present:
        starts, targets = _block(uri, bounds, k)
        sources = np.repeat(np.arange(bounds[k], bounds[k + 1], dtype=np.int32), np.diff(starts))
        for own, other in ((sources, targets), (targets, sources)):
            order = np.argsort(own, kind="stable")
            own = own[order]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            n_each = np.diff(np.append(heads, len(own)))
            near[at[own] + np.arange(len(own)) - np.repeat(heads, n_each)] = other[order]
            at[own[heads]] += n_each
    return ends, near
