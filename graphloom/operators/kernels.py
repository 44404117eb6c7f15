"""Sequential algorithms over one component's rows, run inside executor tasks.

Each kernel takes a pandas frame and returns one.  They are for semantics that are
sequential by nature (depth-first order, low links, augmenting paths) and are bounded: a
component with more than ``MAX_ROWS`` rows raises ``KernelSizeError`` in place of filling a
task.  None recurses, so depth is no limit.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import KernelSizeError

MAX_ROWS = 5_000_000


def by_component(df: DataFrame, keys: list[str], kernel: Callable, schema: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Runs the kernel on the rows of each key, after checking the largest."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > max_rows:
        raise KernelSizeError(f"a component has {largest} rows; a kernel takes {max_rows}")
    return df.groupBy(*keys).applyInPandas(lambda pdf: kernel(pdf), schema)


def single(df: DataFrame, kernel: Callable, schema: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Runs the kernel once on all rows."""
    return by_component(df.withColumn("_all", F.lit(1)), ["_all"], kernel, schema, max_rows)


def frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def neighbours(pdf: pd.DataFrame) -> dict:
    """vertex -> [(neighbour, eid)] in arc order."""
    out = defaultdict(list)
    for s, t, e in zip(pdf.src, pdf.dst, pdf.eid):
        out[s].append((t, e))
    return out


# -- traversal ----------------------------------------------------------------------------


def depth_first(pdf: pd.DataFrame, start, post: bool) -> pd.DataFrame:
    """Vertices in depth-first order from ``start``, arcs in their order."""
    pdf = pdf[pdf.eid.notna()].sort_values("ord")
    out = neighbours(pdf)
    seen, order, stack = {start}, [] if post else [start], [(start, iter(out[start]))]
    while stack:
        v, rest = stack[-1]
        for t, _ in rest:
            if t not in seen:
                seen.add(t)
                if not post:
                    order.append(t)
                stack.append((t, iter(out[t])))
                break
        else:
            stack.pop()
            if post:
                order.append(v)
    return frame(list(enumerate(order)), ["pos", "id"])[["id", "pos"]]


def a_cycle(pdf: pd.DataFrame, directed: bool) -> pd.DataFrame:
    """The vertices of some cycle among the arcs; the last one leads to the first."""
    pdf = pdf.sort_values("ord")
    out = neighbours(pdf)
    done: set = set()
    for root in dict.fromkeys(pdf.src):
        if root in done:
            continue
        path, place = [root], {root: 0}
        stack = [(root, None, iter(out[root]))]
        while stack:
            v, came, rest = stack[-1]
            for t, e in rest:
                if not directed and e == came:
                    continue  # the edge just walked, this instance only
                if t in place:
                    return frame(list(enumerate(path[place[t] :])), ["pos", "id"])[["id", "pos"]]
                if t not in done:
                    place[t] = len(path)
                    path.append(t)
                    stack.append((t, e, iter(out[t])))
                    break
            else:
                stack.pop()
                path.pop()
                del place[v]
                done.add(v)
    return frame([], ["id", "pos"])


def accept_acyclic(pdf: pd.DataFrame) -> pd.DataFrame:
    """eids that are accepted in order without closing a cycle; old ones always are."""
    out, taken = defaultdict(list), []
    for s, t, e, old in pdf.sort_values("ord")[["src", "dst", "eid", "old"]].itertuples(index=False):
        if not old:
            seen, todo = {t}, [t]
            while todo and s not in seen:
                for x in out[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            if s in seen:
                continue
        out[s].append(t)
        taken.append(e)
    return frame([(e,) for e in taken], ["eid"])


# -- connectivity -------------------------------------------------------------------------


def low_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bridges (eid) and articulation points (id) of an undirected component's arcs."""
    out = neighbours(pdf.sort_values("ord"))
    found, low, rows = {}, {}, []
    for root in list(out):
        if root in found:
            continue
        found[root] = low[root] = len(found)
        stack, children, cut = [(root, None, iter(out[root]))], 0, set()
        while stack:
            v, came, rest = stack[-1]
            for t, e in rest:
                if e == came or t == v:
                    continue
                if t in found:
                    low[v] = min(low[v], found[t])
                else:
                    found[t] = low[t] = len(found)
                    stack.append((t, e, iter(out[t])))
                    break
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[v])
                    if low[v] > found[p]:
                        rows.append((came, None))
                    if p == root:
                        children += 1
                    elif low[v] >= found[p]:
                        cut.add(p)
        rows += [(None, v) for v in cut] + ([(None, root)] if children > 1 else [])
    result = frame(rows, ["eid", "id"])
    return result.astype({"eid": "Int64"})


# -- structure ----------------------------------------------------------------------------


def maximal_cliques(pdf: pd.DataFrame) -> pd.DataFrame:
    """Maximal cliques whose smallest member is the root of these rows.

    Rows are (root, a, b): a neighbour a of the root, and either b null or an edge a-b
    between two of its neighbours.  Members after the root may join; earlier ones only rule
    out cliques that another root has.  Pivots are taken to cut branches.
    """
    root = pdf.root.iloc[0]
    near = defaultdict(set)
    around = set(pdf.a[pdf.a.notna()])
    for a, b in zip(pdf.a, pdf.b):
        if pd.notna(b):
            near[a].add(b)
            near[b].add(a)
    later, earlier = {v for v in around if v > root}, {v for v in around if v < root}
    cliques, stack = [], [([root], later, earlier)]
    while stack:
        chosen, may, ruled = stack.pop()
        if not may:
            if not ruled:
                cliques.append((sorted(chosen),))
            continue
        pivot = max(may | ruled, key=lambda u: (len(may & near[u]), -hash(u)))
        may = set(may)
        ruled = set(ruled)
        for v in sorted(may - near[pivot]):
            stack.append(([*chosen, v], may & near[v], ruled & near[v]))
            may.remove(v)
            ruled.add(v)
    return frame(cliques, ["clique"])


def saturation_colouring(pdf: pd.DataFrame) -> pd.DataFrame:
    """DSatur colours of a component: rows are vertices (id, ord, null) and neighbour pairs (id, ord, other)."""
    order = dict(zip(pdf.id, pdf.ord))
    near = {v: set() for v in order}
    for v, other in zip(pdf.id, pdf.other):
        if pd.notna(other):
            near[v].add(other)
            near[other].add(v)
    used = {v: set() for v in order}
    heap = [(0, -len(near[v]), order[v], v) for v in order]
    heapq.heapify(heap)
    colour: dict = {}
    while heap:
        saturation, _, _, v = heapq.heappop(heap)
        if v in colour or -saturation != len(used[v]):
            continue
        c = 0
        while c in used[v]:
            c += 1
        colour[v] = c
        for t in near[v]:
            if t not in colour and c not in used[t]:
                used[t].add(c)
                heapq.heappush(heap, (-len(used[t]), -len(near[t]), order[t], t))
    return frame(list(colour.items()), ["id", "color"])


#: Vertices whose saturations have one maximum.
FAN = 64


def saturation_colours(starts: np.ndarray, near: np.ndarray) -> np.ndarray:
    """DSatur colours of vertices that are numbered by falling degree, then insertion.

    ``starts`` and ``near`` are their rows of neighbours.  The next vertex is found in a tree of maxima, the colours
    around a vertex are bits.
    """
    n = len(starts) - 1
    colours = np.full(n, -1, np.int32)
    tree = [np.full(-(-n // FAN) * FAN, -1, np.int32)]
    tree[0][:n] = 0
    while len(tree[-1]) > FAN:
        top = tree[-1].reshape(-1, FAN).max(axis=1)
        tree.append(np.concatenate([top, np.full(-len(top) % FAN, -1, np.int32)]))
    words = [np.zeros(n, np.uint64)]
    for _ in range(n):
        v = 0
        for level in reversed(tree):
            v = v * FAN + int(level[v * FAN : (v + 1) * FAN].argmax())
        colour = 0
        for used in words:
            free = ~int(used[v]) & (2**64 - 1)
            if free:
                colour += (free & -free).bit_length() - 1
                break
            colour += 64
        else:
            words.append(np.zeros(n, np.uint64))
        colours[v] = colour
        tree[0][v] = -1
        at = v
        for low, high in zip(tree, tree[1:]):
            at //= FAN
            high[at] = low[at * FAN : (at + 1) * FAN].max()
        around, bit = near[starts[v] : starts[v + 1]], np.uint64(1 << colour % 64)
        used = words[colour // 64]
        new = around[(colours[around] < 0) & ((used[around] & bit) == 0)]
        if len(new):
            used[new] |= bit
            tree[0][new] += 1
            much = tree[0][new]
            for high in tree[1:]:
                new = new // FAN
                np.maximum.at(high, new, much)
    return colours


# -- flow, matching, trails ---------------------------------------------------------------


class Residual:
    """Residual arcs in pairs: arc a and its reverse a ^ 1."""

    def __init__(self, pdf: pd.DataFrame):
        self.to, self.room, self.out, self.eid = [], [], defaultdict(list), []
        for s, t, e, c in zip(pdf.src, pdf.dst, pdf.eid, pdf.capacity):
            self.out[s].append(len(self.to))
            self.out[t].append(len(self.to) + 1)
            self.to += [t, s]
            self.room += [c, c - c]
            self.eid.append(e)

    def levels(self, source) -> dict:
        level, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            for a in self.out[v]:
                if self.room[a] > 0 and self.to[a] not in level:
                    level[self.to[a]] = level[v] + 1
                    queue.append(self.to[a])
        return level

    def flows(self) -> pd.DataFrame:
        return frame([(e, self.room[2 * k + 1]) for k, e in enumerate(self.eid)], ["eid", "flow"])

    def push(self, path: list[int]) -> None:
        least = min(self.room[a] for a in path)
        for a in path:
            self.room[a] -= least
            self.room[a ^ 1] += least


def shortest_augmenting(pdf: pd.DataFrame, source, sink) -> pd.DataFrame:
    """Flow of each edge by augmenting along shortest paths."""
    net = Residual(pdf.sort_values("ord"))
    while True:
        came, queue = {source: None}, deque([source])
        while queue and sink not in came:
            v = queue.popleft()
            for a in net.out[v]:
                if net.room[a] > 0 and net.to[a] not in came:
                    came[net.to[a]] = a
                    queue.append(net.to[a])
        if sink not in came:
            return net.flows()
        path, v = [], sink
        while came[v] is not None:
            path.append(came[v])
            v = net.to[came[v] ^ 1]
        net.push(path)


def blocking_flows(pdf: pd.DataFrame, source, sink) -> pd.DataFrame:
    """Flow of each edge by blocking flows in level graphs, with cursors that never go back."""
    net = Residual(pdf.sort_values("ord"))
    while sink in (level := net.levels(source)):
        cursor, path, v = defaultdict(int), [], source
        while True:
            if v == sink:
                net.push(path)
                full = next(k for k, a in enumerate(path) if net.room[a] <= 0)
                v = net.to[path[full] ^ 1]
                del path[full:]
            while cursor[v] < len(net.out[v]):
                a = net.out[v][cursor[v]]
                if net.room[a] > 0 and level.get(net.to[a]) == level[v] + 1:
                    break
                cursor[v] += 1
            else:
                if not path:
                    break
                v = net.to[path.pop() ^ 1]
                cursor[v] += 1
                continue
            path.append(a)
            v = net.to[a]
    return net.flows()


def layered_matching(pdf: pd.DataFrame) -> pd.DataFrame:
    """A maximum matching of a bipartite component's edges (left, right, eid), by layered augmenting paths."""
    near, name = defaultdict(list), {}
    for u, v, e in pdf.sort_values("ord")[["left", "right", "eid"]].itertuples(index=False):
        if (u, v) not in name:
            name[u, v] = e
            near[u].append(v)
    mate_of_left, mate_of_right = {}, {}
    while True:
        layer = {u: 0 for u in near if u not in mate_of_left}
        queue, free = deque(layer), False
        while queue:
            u = queue.popleft()
            for v in near[u]:
                w = mate_of_right.get(v)
                if w is None:
                    free = True
                elif w not in layer:
                    layer[w] = layer[u] + 1
                    queue.append(w)
        if not free:
            return frame([(name[u, v],) for u, v in mate_of_left.items()], ["eid"])
        rest = {u: iter(near[u]) for u in layer}
        for root in [u for u in layer if layer[u] == 0]:
            path = [root]
            via: list = []
            while path:
                u = path[-1]
                for v in rest[u]:
                    w = mate_of_right.get(v)
                    if w is None:
                        for x, y in zip(path, [*via, v]):
                            mate_of_left[x], mate_of_right[y] = y, x
                        path = []
                        break
                    if layer.get(w) == layer[u] + 1:
                        path.append(w)
                        via.append(v)
                        break
                else:
                    path.pop()
                    if via:
                        via.pop()


def trail(pdf: pd.DataFrame, start, directed: bool) -> pd.DataFrame:
    """An Eulerian trail from ``start`` over every edge once, spliced from closed walks."""
    pdf = pdf.sort_values("ord")
    out = defaultdict(list)
    for s, t, e in zip(pdf.src, pdf.dst, pdf.eid):
        out[s].append((t, e))
        if not directed and s != t:
            out[t].append((s, e))
    rest, used = {v: iter(arcs) for v, arcs in out.items()}, set()
    stack, walked = [(start, None)], []
    while stack:
        for t, e in rest.get(stack[-1][0], ()):
            if e not in used:
                used.add(e)
                stack.append((t, e))
                break
        else:
            v, e = stack.pop()
            if e is not None:
                walked.append((e, stack[-1][0], v))
    walked.reverse()
    return frame([(k, *row) for k, row in enumerate(walked)], ["pos", "eid", "from_id", "to_id"])


def trails(pdf: pd.DataFrame, directed: bool) -> pd.DataFrame:
    """Trails that take every edge once, one a component or one for each two uneven ends; named by their first edge.

    Edges that are added make all vertices even; the closed trails are cut where they take one.
    """
    src, dst, eid = (x.tolist() for x in (pdf.src, pdf.dst, pdf.eid))
    surplus = defaultdict(int)
    for s, t in zip(src, dst):
        surplus[s] += 1
        surplus[t] += -1 if directed else 1
    if directed:
        more = [v for v, x in surplus.items() for _ in range(x)]
        less = [v for v, x in surplus.items() for _ in range(-x)]
    else:
        odd = [v for v, x in surplus.items() if x % 2]
        more, less = odd[::2], odd[1::2]
    real = len(src)
    src, dst = src + less, dst + more
    out = defaultdict(list)
    for k in range(len(src) - 1, -1, -1):
        out[src[k]].append(k)
        if not directed and src[k] != dst[k]:
            out[dst[k]].append(k)
    used, rows = bytearray(len(src)), []
    for root in list(out):
        stack, walked = [(root, -1)], []
        while stack:
            v, came = stack[-1]
            arcs = out[v]
            while arcs and used[arcs[-1]]:
                arcs.pop()
            if arcs:
                k = arcs.pop()
                used[k] = 1
                stack.append((dst[k] if src[k] == v else src[k], k))
            else:
                stack.pop()
                if came >= 0:
                    walked.append((came, stack[-1][0], v))
        walked.reverse()
        # a closed trail begins after an added edge, if it has one
        added = next((i for i, (k, _, _) in enumerate(walked) if k >= real), -1)
        piece, at = None, 0
        for k, v, t in walked[added + 1 :] + walked[: added + 1]:
            if k >= real:
                piece = None
                continue
            if piece is None:
                piece, at = eid[k], 0
            rows.append((piece, at, eid[k], v, t))
            at += 1
    return frame(rows, ["piece", "at", "eid", "from_id", "to_id"])


def goal_directed(pdf: pd.DataFrame, source, target, estimate: Callable) -> pd.DataFrame:
    """A* with vertices settled once: rows are arcs with a weight; (pos, id, distance) of the path."""
    out = defaultdict(list)
    for s, t, w in pdf.sort_values("ord")[["src", "dst", "weight"]].itertuples(index=False):
        out[s].append((t, w))
    zero = pdf.weight.iloc[0] * 0 if len(pdf) else 0
    dist, came, settled, n = {source: zero}, {}, set(), 0
    heap = [(estimate(source, target), 0, source)]
    while heap:
        _, _, v = heapq.heappop(heap)
        if v in settled:
            continue
        settled.add(v)
        if v == target:
            path = [v]
            while path[-1] in came:
                path.append(came[path[-1]])
            return frame([(k, x, dist[x]) for k, x in enumerate(reversed(path))], ["pos", "id", "distance"])
        for t, w in out[v]:
            if w < 0:
                return frame([(-1, v, w)], ["pos", "id", "distance"])
            if t not in settled and (t not in dist or dist[v] + w < dist[t]):
                dist[t], came[t] = dist[v] + w, v
                n += 1
                heapq.heappush(heap, (dist[t] + estimate(t, target), n, t))
    return frame([], ["pos", "id", "distance"])


def grown(pdf: pd.DataFrame) -> pd.DataFrame:
    """eids of a tree's edges in the order in which it grows from its first vertex, the least (weight, order) at its rim first."""
    near, rim, out = defaultdict(list), [], []
    for a, b, w, o, e in pdf[["src_ord", "dst_ord", "weight", "ord", "eid"]].itertuples(index=False):
        near[a].append((w, o, e, b))
        near[b].append((w, o, e, a))
    inside = {min(near)}
    for edge in near[min(near)]:
        heapq.heappush(rim, edge)
    while rim:
        _, _, e, v = heapq.heappop(rim)
        if v not in inside:
            inside.add(v)
            out.append((e, len(out)))
            for edge in near[v]:
                if edge[3] not in inside:
                    heapq.heappush(rim, edge)
    return frame(out, ["eid", "step"])
