"""Few edges that stand for many: certificates of two-connectivity, made in parts and joined.

The certificate of a set of edges is a breadth-first forest and a spanning forest of the rest.
Taking out any vertex or edge leaves the same components of either, whatever edges are
added, so certificates of parts can be put together and certified again: a task holds two
edges a vertex (four with parallel ones) and those it reads at once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Edges that are read together.
READ = 2_000_000
#: Numbers an edge up to which ids from the least to the greatest are looked up in a table.
CLOSE = 4


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of edges that form a spanning forest of vertices 0 to n - 1."""
    label, left, chosen, up = np.arange(n, dtype=np.int32), np.arange(len(a)), [], False
    while True:
        x, y = label[a[left]], label[b[left]]
        open_ = x != y
        left, x, y = left[open_], x[open_], y[open_]
        if not len(left):
            return np.concatenate(chosen) if chosen else left
        # every tree with a neighbour on that side of its label is hung on one of them; sides alternate, so stars take two rounds
        up = not up
        child, parent = (np.maximum(x, y), np.minimum(x, y)) if up else (np.minimum(x, y), np.maximum(x, y))
        edge = np.full(n, -1, np.int64)
        edge[child] = np.arange(len(left))
        hung = np.flatnonzero(edge >= 0)
        taken = edge[hung]
        chosen.append(left[taken])
        root = np.arange(n, dtype=np.int32)
        root[hung] = parent[taken]
        while not np.array_equal(further := root[root], root):
            root = further
        label = root[label]


def numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids in order, numbers of a, numbers of b); never an order of both together."""
    low, high = (min(int(a.min()), int(b.min())), max(int(a.max()), int(b.max()))) if len(a) else (0, -1)
    if high - low < CLOSE * len(a):
        at = np.zeros(high - low + 1, np.int32)
        at[a - low] = at[b - low] = 1
        ids = np.flatnonzero(at) + low
        np.cumsum(at, out=at)
        at -= 1
        return ids, at[a - low], at[b - low]
    own, s = np.unique(a, return_inverse=True)
    s = s.astype(np.int32)
    other, t = np.unique(b, return_inverse=True)
    t = t.astype(np.int32)
    ids = np.union1d(own, other)
    return ids, np.searchsorted(ids, own).astype(np.int32)[s], np.searchsorted(ids, other).astype(np.int32)[t]


def rows_of(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, neighbours, positions of the edges) of the edges in both directions."""
    # an end and its place in one number, ordered in place
    order = np.concatenate([a, b]).astype(np.int64)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(order, minlength=n), out=starts[1:])
    order <<= 32
    order |= np.arange(len(order), dtype=np.int32)
    order.sort()
    order &= 0xFFFFFFFF
    order = order.astype(np.int32)
    near = np.concatenate([b, a]).astype(np.int32, copy=False)[order]
    order %= np.int32(max(1, len(a)))
    return starts, near, order


def breadth_first(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the edges of a breadth-first forest: each vertex is scanned once, with all its edges."""
    starts, near, edges = rows_of(n, a, b)
    starts, near, seen, queue, found = memoryview(starts), memoryview(near), bytearray(n), array("i"), array("i")
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = 1
        queue.append(root)
        at = len(queue) - 1
        while at < len(queue):
            v = queue[at]
            at += 1
            for k in range(starts[v], starts[v + 1]):
                t = near[k]
                if not seen[t]:
                    seen[t] = 1
                    queue.append(t)
                    found.append(k)
    return edges[np.frombuffer(found, np.int32)] if found else np.empty(0, np.int32)


def certified(a: np.ndarray, b: np.ndarray, eid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The certificate's edges (a, b, eid); there are no loops."""
    ids, s, t = numbered(a, b)
    # a scan takes one edge to each neighbour, so the forests are of different pairs; a pair's second edge goes with its first
    pair = np.minimum(s, t).astype(np.int64) * len(ids) + np.maximum(s, t)
    second = of = first = None
    together = np.sort(pair)
    if (together[1:] == together[:-1]).any():
        del together
        order = np.argsort(pair, kind="stable")
        again = np.diff(pair[order], prepend=-1) == 0
        second = order[again & ~np.roll(again, 1)]
        of = order[np.flatnonzero(again & ~np.roll(again, 1)) - 1]
        first = np.sort(order[~again])
        del order, again
        s, t = s[first], t[first]
    together = pair = None
    rest = np.ones(len(s), bool)
    rest[breadth_first(len(ids), s, t)] = False
    other = np.flatnonzero(rest)
    taken = ~rest
    taken[other[spanning(len(ids), s[other], t[other])]] = True
    if first is None:
        return a[taken], b[taken], eid[taken]
    kept = np.zeros(len(a), bool)
    kept[first[taken]] = True
    kept[second[kept[of]]] = True
    return a[kept], b[kept], eid[kept]


def _certificate(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held, size = [[np.empty(0, np.int64)] for _ in range(3)], 0

    def certify() -> None:
        columns = []
        for parts in held:
            columns.append(np.concatenate(parts))
            parts.clear()  # each column is there twice only while it is joined
        for parts, kept in zip(held, certified(*columns)):
            parts.append(kept)

    for batch in batches:
        for parts, c in zip(held, batch.columns):
            parts.append(c.cast(pa.int64()).to_numpy(zero_copy_only=False))
        size += len(batch)
        if size >= READ:
            certify()
            size = 0
    if size:
        certify()
    return tuple(parts[0] for parts in held)


def _slices(names: list[str], columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([c.slice(k, 100_000) for c in columns], names)


def low_links(edges: DataFrame) -> DataFrame:
    """(eid, id): the bridges among edges (a, b, eid) of integers without loops, and the articulation points."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _slices(["a", "b", "eid"], [pa.array(x) for x in _certificate(batches)])

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bridges, points = _low_links(*_certificate(batches))
        nothing = lambda x: pa.nulls(len(x), pa.int64())
        yield from _slices(["eid", "id"], [pa.array(bridges), nothing(bridges)])
        yield from _slices(["eid", "id"], [nothing(points), pa.array(points)])

    some = edges.select("a", "b", "eid").coalesce(max(2, edges.sparkSession.sparkContext.defaultParallelism))
    return some.mapInArrow(part, "a long, b long, eid long").repartition(1).mapInArrow(whole, "eid long, id long")


def _low_links(a: np.ndarray, b: np.ndarray, eid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bridges' eids and articulation points."""
    ids, s, t = numbered(a, b)
    n = len(ids)
    starts, near, edges = (memoryview(x) for x in rows_of(n, s, t))
    del s, t
    found, low, came, cursor = array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("q", starts[:n].tobytes())
    bridges, cut, count = array("i"), bytearray(n), 0
    for root in range(n):
        if found[root]:
            continue
        count += 1
        found[root] = low[root] = count
        came[root] = -1
        stack, children = array("i", [root]), 0
        while stack:
            v = stack[-1]
            k = cursor[v]
            if k < starts[v + 1]:
                cursor[v] = k + 1
                t, e = near[k], edges[k]
                if e == came[v]:
                    continue
                if found[t]:
                    if found[t] < low[v]:
                        low[v] = found[t]
                else:
                    count += 1
                    found[t] = low[t] = count
                    came[t] = e
                    stack.append(t)
            else:
                stack.pop()
                if stack:
                    p = stack[-1]
                    if low[v] < low[p]:
                        low[p] = low[v]
                    if low[v] > found[p]:
                        bridges.append(came[v])
                    if p == root:
                        children += 1
                    elif low[v] >= found[p]:
                        cut[p] = 1
        if children > 1:
            cut[root] = 1
    return eid[np.frombuffer(bridges, np.int32)] if bridges else eid[:0], ids[np.frombuffer(cut, np.uint8) > 0]


def _covered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends, ends, positions of the edges that span the cover): every vertex twice, every edge between opposite copies."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    s, t, n = at[: len(a)].astype(np.int32), at[len(a) :].astype(np.int32), np.int32(len(ids))
    del at
    u, v = np.concatenate([s, s + n]), np.concatenate([t + n, t])
    return ids, u, v, spanning(2 * len(ids), u, v)


def parities(edges: DataFrame) -> DataFrame:
    """(id, even, odd, left): the components of both copies of each end of edges (a, b) of integers, and whether the even one has the first vertex's even copy.

    Parts of the edges are reduced to those that span their cover, which joins the same copies.
    """

    def reduced(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        a = b = np.empty(0, np.int64)
        held, size = [], 0

        def kept():
            x, y = (np.concatenate([k, *z]) for k, z in zip((a, b), zip(*held)))
            some = np.unique(_covered(x, y)[3] % len(x))
            return x[some], y[some]

        for batch in batches:
            held.append([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            size += len(batch)
            if size >= READ:
                a, b = kept()
                held, size = [], 0
        return kept() if held else (a, b)

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _slices(["a", "b"], [pa.array(x) for x in reduced(batches)])

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = reduced(batches)
        if len(a):
            ids, u, v, tree = _covered(a, b)
            label = joined(2 * len(ids), u[tree], v[tree])
            even, odd = label[: len(ids)], label[len(ids) :]
            firsts = []
            for own in (even, odd):
                first = np.full(2 * len(ids), len(ids), np.int32)
                first[own[::-1]] = np.arange(len(ids), dtype=np.int32)[::-1]
                firsts.append(first)
            yield from _slices(["id", "even", "odd", "left"], [pa.array(ids), pa.array(even), pa.array(odd), pa.array(firsts[0][even] < firsts[1][even])])

    some = edges.select("a", "b").coalesce(max(2, edges.sparkSession.sparkContext.defaultParallelism))
    return some.mapInArrow(part, "a long, b long").repartition(1).mapInArrow(whole, "id long, even int, odd int, left boolean")


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components' labels of vertices 0 to n - 1, by a walk along the edges of a forest."""
    starts, near, _ = rows_of(n, a, b)
    starts, near, label = memoryview(starts), memoryview(near), array("i", [-1]) * n
    for root in range(n):
        if label[root] < 0:
            label[root] = root
            todo = [root]
            while todo:
                v = todo.pop()
                for k in range(starts[v], starts[v + 1]):
                    if label[near[k]] < 0:
                        label[near[k]] = root
                        todo.append(near[k])
    return np.frombuffer(label, np.int32)
