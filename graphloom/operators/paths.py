"""Shortest, longest and critical paths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NegativeCycleError, NegativeWeightError
from ..functions import fanout
from ..graph import PropertyGraph
from ..plans.lineage import cut
from ..plans.supersteps import check
from . import kernels, traversal


@dataclass
class ShortestPathResult:
    """The path between two vertices; ``path`` is empty and ``distance`` an error if there is none."""

    source: Any
    target: Any
    is_reachable: bool
    path: list
    _distance: Any = None

    @property
    def distance(self) -> Any:
        if not self.is_reachable:
            raise ValueError(f"{self.target!r} can't be reached from {self.source!r}")
        return self._distance


class ShortestPathAlgorithm(Protocol):
    """A strategy for single-pair shortest paths."""

    def find_path(self, g: PropertyGraph, source: Any, target: Any) -> ShortestPathResult: ...


class SingleSourcePaths:
    """Distances from one source as a DataFrame (id, distance, predecessor)."""

    def __init__(self, g: PropertyGraph, source: Any, rows: DataFrame):
        self.graph, self.source, self.rows = g, source, rows

    @property
    def distances(self) -> DataFrame:
        return self.rows.select("id", "distance")

    def is_reachable(self, target: Any) -> bool:
        self.graph._known(target)
        return not self.rows.where(F.col("id") == F.lit(target)).isEmpty()

    def to(self, target: Any) -> ShortestPathResult:
        """The path to a vertex; rounds of doubled jumps over the predecessors, so they grow with its logarithm."""
        self.graph._known(target)
        row = self.rows.where(F.col("id") == F.lit(target)).first()
        if row is None:
            return ShortestPathResult(self.source, target, False, [])
        jump = cut(self.rows.where("predecessor is not null").select("id", F.col("predecessor").alias("up")))
        jumps = []
        while not jump.where(F.col("id") == F.lit(target)).isEmpty():
            jumps.append(jump)
            jump = cut(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")))
        found = self.rows.where(F.col("id") == F.lit(target)).select("id", F.lit(0).cast("long").alias("back"))
        for k in reversed(range(len(jumps))):
            further = found.join(jumps[k], "id").select(F.col("up").alias("id"), (F.col("back") + (1 << k)).alias("back"))
            found = cut(found.unionByName(further))
        path = [r["id"] for r in found.orderBy(F.desc("back")).collect()]
        return ShortestPathResult(self.source, target, True, path, row["distance"])


def _weighted_arcs(g: PropertyGraph, weight: str | None) -> DataFrame:
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    arcs = g.arcs().select("src", "dst", w.alias("w"))
    kind = fanout._wide(arcs.schema["w"].dataType.simpleString())
    arcs = arcs.withColumn("w", F.col("w").cast(kind))
    bad = F.col("w").isNull() | (F.isnan("w") if kind == "double" else F.lit(False))
    return arcs.withColumn("w", F.when(bad, F.raise_error(F.lit("a weight is null or NaN"))).otherwise(F.col("w")))


def _relax(g: PropertyGraph, start: DataFrame, arcs: DataFrame, longest: bool, rounds: int | None, should_stop) -> tuple[DataFrame, bool]:
    """((id, distance, predecessor), whether it settled) from the starting rows (id, distance).

    A superstep offers each fresh vertex's distance along its arcs; of equal offers the one of
    the predecessor inserted first is taken, and only a strictly better one replaces what is
    there, so predecessors always form paths.
    """
    orders = g.vertices.select("id", "ord")
    arcs = cut(arcs.join(orders.select(F.col("id").alias("src"), F.col("ord").alias("src_ord")), "src"))
    kind = arcs.schema["w"].dataType.simpleString()
    none = F.lit(None).cast(g.vertices.schema["id"].dataType)
    state = cut(start.select("id", F.col("distance").cast(kind).alias("distance"), none.alias("predecessor"), F.lit(True).alias("fresh")))
    done = 0
    while rounds is None or done < rounds:
        check(should_stop)
        done += 1
        moves = state.where("fresh").select(F.col("id").alias("src"), "distance").join(arcs, "src")
        moves = moves.select(F.col("dst").alias("id"), (F.col("distance") + F.col("w")).cast(kind).alias("d"), "src_ord", "src")
        if longest:
            best = F.max(F.struct("d", (-F.col("src_ord")).alias("o"), "src"))
        else:
            best = F.min(F.struct("d", F.col("src_ord").alias("o"), "src"))
        offers = moves.groupBy("id").agg(best.alias("best")).select("id", F.col("best.d").alias("offer"), F.col("best.src").alias("via"))
        gain = F.col("offer") > F.col("distance") if longest else F.col("offer") < F.col("distance")
        better = F.coalesce(F.col("offer").isNotNull() & (F.col("distance").isNull() | gain), F.lit(False))
        joined = state.select("id", "distance", "predecessor").join(offers, "id", "full")
        state = cut(
            joined.select(
                "id",
                F.when(better, F.col("offer")).otherwise(F.col("distance")).alias("distance"),
                F.when(better, F.col("via")).otherwise(F.col("predecessor")).alias("predecessor"),
                better.alias("fresh"),
            )
        )
        if state.where("fresh").isEmpty():
            return state.drop("fresh"), True
    return state.drop("fresh"), False


def _start(g: PropertyGraph, source: Any) -> DataFrame:
    g._known(source)
    return g.vertices.where(F.col("id") == F.lit(source)).select("id", F.lit(0).alias("distance"))


class Dijkstra:
    """Non-negative weights; None counts edges.

    A negative arc is an error only if it would be walked: if it leaves a vertex that is
    reached (over non-negative arcs), and, for one target, before the target is.
    """

    def __init__(self, weight: str | None = None):
        self.weight = weight

    def _run(self, g: PropertyGraph, source: Any, target: Any, should_stop) -> DataFrame:
        arcs = _weighted_arcs(g, self.weight)
        rows, _ = _relax(g, _start(g, source), arcs.where("w >= 0"), False, None, should_stop)
        leaving = arcs.where("w < 0").join(rows, arcs.src == rows.id)
        if target is not None:
            end = rows.where(F.col("id") == F.lit(target)).select("distance").first()
            if end is not None:
                leaving = leaving.where(F.col("distance") < F.lit(end[0]))
        if not leaving.isEmpty():
            raise NegativeWeightError("a negative weight leaves a vertex on the way")
        return rows

    def find_path(self, g: PropertyGraph, source: Any, target: Any, should_stop=None) -> ShortestPathResult:
        g._known(target)
        return SingleSourcePaths(g, source, self._run(g, source, target, should_stop)).to(target)

    def find_paths_from(self, g: PropertyGraph, source: Any, should_stop=None) -> SingleSourcePaths:
        return SingleSourcePaths(g, source, self._run(g, source, None, should_stop))


class BellmanFord:
    """Any weights; a negative cycle that the source reaches is an error."""

    def __init__(self, weight: str):
        self.weight = weight

    def find_paths_from(self, g: PropertyGraph, source: Any, should_stop=None) -> SingleSourcePaths:
        # after V - 1 rounds everything is settled, and the next one only sees that it is
        rows, settled = _relax(g, _start(g, source), _weighted_arcs(g, self.weight), False, max(1, g.vertex_count()), should_stop)
        if not settled:
            raise NegativeCycleError("the source reaches a negative cycle")
        return SingleSourcePaths(g, source, rows)

    def find_path(self, g: PropertyGraph, source: Any, target: Any, should_stop=None) -> ShortestPathResult:
        g._known(target)
        return self.find_paths_from(g, source, should_stop).to(target)


class AStar:
    """Non-negative weights and a Python estimate of the rest of the way.

    Vertices are settled once, so the path is shortest if the estimate is consistent.  It
    runs in one task on what the source reaches.
    """

    def __init__(self, weight: str, heuristic: Callable[[Any, Any], Any]):
        self.weight, self.heuristic = weight, heuristic

    def find_path(self, g: PropertyGraph, source: Any, target: Any, should_stop=None) -> ShortestPathResult:
        g._known(source)
        g._known(target)
        if source == target:
            return ShortestPathResult(source, target, True, [source], 0)
        rows = traversal._reached_arcs(g, source, should_stop).where("eid is not null")
        weights = g.edges.select("eid", F.col(self.weight).alias("weight"))
        arcs = rows.join(weights, "eid")
        kinds = g.vertices.schema["id"].dataType.simpleString(), arcs.schema["weight"].dataType.simpleString()
        heuristic = self.heuristic
        found = kernels.single(arcs, lambda pdf: kernels.goal_directed(pdf, source, target, heuristic), f"pos long, id {kinds[0]}, distance {kinds[1]}")
        path = found.orderBy("pos").collect()
        if path and path[0]["pos"] < 0:
            raise NegativeWeightError("a negative weight leaves a vertex on the way")
        if not path:
            return ShortestPathResult(source, target, False, [])
        return ShortestPathResult(source, target, True, [r["id"] for r in path], path[-1]["distance"])


class AllPairs:
    """Every pair's distance as a DataFrame (source, target, distance)."""

    def __init__(self, g: PropertyGraph, rows: DataFrame, arcs: DataFrame):
        self.graph, self.rows, self._arcs = g, rows, arcs

    def between(self, s: Any, t: Any) -> ShortestPathResult:
        self.graph._known(s)
        self.graph._known(t)
        row = self.rows.where((F.col("source") == F.lit(s)) & (F.col("target") == F.lit(t))).first()
        if row is None:
            return ShortestPathResult(s, t, False, [])
        to = self.rows.where(F.col("source") == F.lit(s)).select(F.col("target").alias("id"), "distance")
        tight = self._arcs.join(to.select(F.col("id").alias("src"), F.col("distance").alias("ds")), "src")
        tight = tight.join(to.select(F.col("id").alias("dst"), F.col("distance").alias("dt")), "dst").where("ds + w = dt")
        # arcs on shortest paths; hop levels among them give a path even across zero weights
        hops, _ = _relax(self.graph, _start(self.graph, s), tight.select("src", "dst", F.lit(1).cast("long").alias("w")), False, None, None)
        return ShortestPathResult(s, t, True, SingleSourcePaths(self.graph, s, hops).to(t).path, row["distance"])


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """(s, t, d): the paths of ``a`` followed by those of ``b``."""
    left = a.select("s", F.col("t").alias("m"), F.col("d").alias("d1"))
    right = b.select(F.col("s").alias("m"), "t", F.col("d").alias("d2"))
    return left.join(right, "m").select("s", "t", (F.col("d1") + F.col("d2")).alias("d"))


class FloydWarshall:
    """All pairs with any weights; a negative cycle anywhere is an error.

    Distances over paths of twice the length come from joining two tables of pairs, of which
    one holds what got shorter in the last round, so the rounds grow with the logarithm of the
    longest shortest path and a round costs what is new.
    """

    def __init__(self, weight: str):
        self.weight = weight

    def compute(self, g: PropertyGraph, should_stop=None) -> AllPairs:
        arcs = cut(_weighted_arcs(g, self.weight))
        kind = arcs.schema["w"].dataType.simpleString()
        itself = g.vertices.select(F.col("id").alias("s"), F.col("id").alias("t"), F.lit(0).cast(kind).alias("d"))
        first = arcs.select(F.col("src").alias("s"), F.col("dst").alias("t"), F.col("w").alias("d"))
        table = cut(first.unionByName(itself).groupBy("s", "t").agg(F.min("d").alias("d")))
        fresh = table
        while not fresh.isEmpty():
            check(should_stop)
            if not fresh.where("s = t and d < 0").isEmpty():
                raise NegativeCycleError("the graph has a negative cycle")
            # a pair gets shorter only by a half that did in the last round
            longer = _joined(fresh, table) if fresh is table else _joined(fresh, table).unionByName(_joined(table, fresh))
            both = longer.select("s", "t", "d", F.lit(None).cast(kind).alias("old")).unionByName(table.select("s", "t", "d", F.col("d").alias("old")))
            marked = cut(both.groupBy("s", "t").agg(F.min("d").cast(kind).alias("d"), F.min("old").alias("old")))
            fresh = marked.where("old is null or d < old").drop("old")
            table = marked.drop("old")
        rows = table.select(F.col("s").alias("source"), F.col("t").alias("target"), F.col("d").alias("distance"))
        return AllPairs(g, rows, arcs)


def shortest_path(g: PropertyGraph, source: Any, target: Any, weight: str | None = "weight", should_stop=None) -> ShortestPathResult:
    return Dijkstra(weight).find_path(g, source, target, should_stop)


def shortest_paths_from(g: PropertyGraph, source: Any, weight: str | None = "weight", should_stop=None) -> SingleSourcePaths:
    return Dijkstra(weight).find_paths_from(g, source, should_stop)


def dag_shortest_paths_from(g: PropertyGraph, source: Any, weight: str = "weight", should_stop=None) -> SingleSourcePaths:
    """Shortest paths in an acyclic graph; a cycle anywhere is an error, negative weights are none."""
    g.require_acyclic()
    return SingleSourcePaths(g, source, _relax(g, _start(g, source), _weighted_arcs(g, weight), False, None, should_stop)[0])


def dag_longest_paths_from(g: PropertyGraph, source: Any, weight: str = "weight", should_stop=None) -> SingleSourcePaths:
    g.require_acyclic()
    return SingleSourcePaths(g, source, _relax(g, _start(g, source), _weighted_arcs(g, weight), True, None, should_stop)[0])


def critical_path(g: PropertyGraph, weight: str = "weight", should_stop=None) -> ShortestPathResult:
    """The path of the greatest total weight; of equal ends the first in topological order."""
    order = cut(traversal.topological_order(g, should_stop))
    if order.isEmpty():
        raise ValueError("an empty graph has no critical path")
    start = g.vertices.select("id", F.lit(0).alias("distance"))
    rows, _ = _relax(g, start, _weighted_arcs(g, weight), True, None, should_stop)
    end = rows.join(order, "id").orderBy(F.desc("distance"), F.asc("pos")).first()
    found = SingleSourcePaths(g, None, rows).to(end["id"])
    found.source = found.path[0]
    return found
