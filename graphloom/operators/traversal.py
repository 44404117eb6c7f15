"""Breadth-first, depth-first and topological order, and cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphCycleError
from ..graph import PropertyGraph
from ..plans.components import star_components
from ..plans.lineage import cut
from ..plans.skew import SENT_KEYS, join_counted
from ..plans.supersteps import check, ranked, reach
from . import kernels

#: Levels whose rows are stored together.
LEVELS_TOGETHER = 32


def bfs(g: PropertyGraph, start, should_stop=None) -> DataFrame:
    """(id, level, pos): breadth-first order from ``start``, neighbours in edge order.

    One level a superstep: a vertex comes by the position of the first vertex that finds it,
    then by the order of the finding arc.
    """
    g._known(start)
    arcs = g.arcs().select("src", "dst", F.col("ord").alias("arc"))
    seen = cut(g.vertices.where(F.col("id") == F.lit(start)).select("id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("pos")))
    frontier, level, count = seen, 0, 1
    while True:
        check(should_stop)
        level += 1
        first = frontier.join(arcs, frontier.id == arcs.src).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("pos", "arc")).alias("key"))
        new = first.join(seen.select("id"), "id", "left_anti")
        placed = ranked(new, F.col("key"), name="rank")
        frontier = cut(placed.select("id", F.lit(level).alias("level"), (F.col("rank") + count).alias("pos")))
        found = frontier.count()
        if not found:
            return seen
        count += found
        seen = cut(seen.unionByName(frontier))


def _reached_arcs(g: PropertyGraph, start, should_stop=None) -> DataFrame:
    arcs = g.arcs().select("src", "dst", "eid", "ord")
    seeds = g.vertices.where(F.col("id") == F.lit(start)).select("id")
    seen = reach(seeds, arcs, should_stop)
    own = seen.where(F.col("level") == 0).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("long").alias("eid"), F.lit(-1).cast("long").alias("ord"))
    return arcs.join(seen.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "eid", "ord").unionByName(own)


def dfs(g: PropertyGraph, start, post_order: bool = False, should_stop=None) -> DataFrame:
    """(id, pos): depth-first order from ``start``, on discovery or after all descendants."""
    g._known(start)
    kind = g.vertices.schema["id"].dataType.simpleString()
    rows = _reached_arcs(g, start, should_stop)
    return kernels.single(rows, lambda pdf: kernels.depth_first(pdf, start, post_order), f"id {kind}, pos long")


def _core(g: PropertyGraph, should_stop=None) -> DataFrame:
    """Directed arcs left when vertices without arcs in or out are taken away until none is."""
    left = g.edges.select("src", "dst", "eid", "ord")
    while True:
        check(should_stop)
        # arcs are written again only if there is something to take away
        ends = left.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(1)).unionByName(left.select(F.col("dst").alias("id")).distinct().withColumn("out", F.lit(0)))
        loose = cut(ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n < 2").select("id"))
        count = loose.count()
        if not count:
            return left
        loose = F.broadcast(loose) if count <= SENT_KEYS else loose
        left = left.join(loose, left.src == loose.id, "left_anti")
        left = cut(left.join(loose, left.dst == loose.id, "left_anti"))


def has_cycle(g: PropertyGraph, should_stop=None) -> bool:
    """Whether there is a cycle; loops are, and so are parallel edges of an undirected graph."""
    if g.directed:
        return not _core(g, should_stop).isEmpty()
    components = star_components(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    joined = components.count() - components.select("component").distinct().count()
    # a spanning forest has a vertex less than its components' vertices for each component
    return g.edge_count() > joined


def _rings(arcs: DataFrame, should_stop=None) -> DataFrame:
    """Arcs (src, dst, eid, ord), one from each vertex that has any in a core, that lie on cycles.

    Every vertex of a core has an arc out, so the first ones alone lead into cycles.  Those that are
    reached by 1, 2, 4 ... further steps are kept until all are, which holds on cycles only.
    """
    first = cut(arcs.groupBy("src").agg(F.min_by(F.struct("dst", "eid", "ord"), "ord").alias("r")).select("src", "r.*"))
    jumps = first.select("src", "dst")
    count = jumps.count()
    while True:
        check(should_stop)
        image = jumps.select(F.col("dst").alias("src")).distinct()
        jumps = cut(jumps.join(image, "src", "left_semi"))
        now = jumps.count()
        if now == count:
            return first.join(jumps.select("src"), "src", "left_semi")
        count = now
        jumps = cut(jumps.join(jumps.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst")))


def find_cycle(g: PropertyGraph, should_stop=None) -> list | None:
    """The vertices of some cycle, the last leading to the first, or None.

    Of a directed graph one task gets only cycles without a vertex in common.  Of an undirected one it gets all arcs.
    """
    kind = g.vertices.schema["id"].dataType.simpleString()
    directed = g.directed
    if directed:
        core = _core(g, should_stop)
        if core.isEmpty():
            return None
        arcs = _rings(core, should_stop)
    else:
        arcs = g.arcs().select("src", "dst", "eid", "ord")
    rows = kernels.single(arcs, lambda pdf: kernels.a_cycle(pdf, directed), f"id {kind}, pos long")
    found = [r["id"] for r in rows.orderBy("pos").collect()]
    return found or None


def topological_order(g: PropertyGraph, should_stop=None) -> DataFrame:
    """(id, level, pos): Kahn's order with a queue, ties by insertion.

    Level by level: level 0 by vertex order; a later vertex by the last of its predecessors'
    positions, then that edge's order.  Each arc carries the number of its target's arcs, so a
    level touches only its arcs and the vertices that some but not all predecessors have met.  A cycle raises ``GraphCycleError`` with its vertices.
    """
    g._directed()
    edges = cut(g.edges.select("src", "dst", F.col("ord").alias("arc")))
    needs = cut(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("need")))
    arcs = cut(join_counted(edges, needs.withColumn("rows", F.col("need")), "dst", "rows"))
    frontier = g.vertices.join(needs.select(F.col("dst").alias("id")), "id", "left_anti")
    frontier = cut(ranked(frontier.select("id", "ord"), F.col("ord")).select("id", F.lit(0).alias("level"), "pos"))
    count, level = frontier.count(), 0
    done, recent, met = None, [frontier], None
    while True:
        check(should_stop)
        level += 1
        new = frontier.join(arcs, frontier.id == arcs.src)
        new = new.select(F.col("dst").alias("id"), F.lit(1).cast("long").alias("n"), F.struct("pos", "arc").alias("last"), "need")
        # positions grow by level, so what was met last is the latest
        open_ = (new if met is None else met.unionByName(new)).groupBy("id")
        open_ = cut(open_.agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.first("need").alias("need")))
        ready, met = open_.where("n = need"), open_.where("n < need")
        frontier = cut(ranked(ready, F.col("last"), name="rank").select("id", F.lit(level).alias("level"), (F.col("rank") + count).alias("pos")))
        found = frontier.count()
        if not found:
            break
        count += found
        recent.append(frontier)
        if len(recent) == LEVELS_TOGETHER:
            done, recent = cut(union(done, recent)), []
    if count < g.vertex_count():
        raise GraphCycleError(find_cycle(g, should_stop))
    return union(done, recent)


def union(done: DataFrame | None, recent: list[DataFrame]) -> DataFrame:
    """All rows of the levels."""
    return reduce(DataFrame.unionByName, recent if done is None else [done, *recent])
