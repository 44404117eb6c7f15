"""Eulerian circuits and paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.components import star_components
from ..plans.lineage import store
from . import kernels

#: Edges from which a trail is made of trails over ``AT_ONCE`` edges each.
PIECED, AT_ONCE = 1_000_000, 500_000


def _odd(g: PropertyGraph) -> DataFrame:
    """(id, surplus) of vertices that are no mere passage: uneven degree, or more arcs out than in."""
    if g.directed:
        ends = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("x")), F.struct(F.col("dst").alias("id"), F.lit(-1).alias("x")))).alias("e"))
        return ends.groupBy("e.id").agg(F.sum("e.x").alias("surplus")).where("surplus <> 0")
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg((F.count(F.lit(1)) % 2).alias("surplus")).where("surplus <> 0")


def _one_piece(g: PropertyGraph) -> bool:
    """Whether all edges are in one component; a lone loop's vertex is a component too."""
    found = star_components(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    loops = g.edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    lone = loops.join(found.select("node"), "node", "left_anti").select(F.col("node").alias("component"))
    return found.select("component").distinct().unionByName(lone).limit(2).count() <= 1


def has_eulerian_circuit(g: PropertyGraph) -> bool:
    """Whether a closed trail takes every edge once; true without edges."""
    return _odd(g).isEmpty() and _one_piece(g)


def has_eulerian_path(g: PropertyGraph) -> bool:
    """Whether a trail takes every edge once; a circuit is one."""
    ends = [abs(r["surplus"]) for r in _odd(g).limit(3).collect()]
    return (not ends or ends == [1, 1]) and _one_piece(g)


def _trail(g: PropertyGraph, start) -> DataFrame:
    kind = g.vertices.schema["id"].dataType.simpleString()
    rows = g.edges.select("src", "dst", "eid", "ord")
    directed = g.directed
    schema = f"pos long, eid long, from_id {kind}, to_id {kind}"
    if g.edges.limit(PIECED + 1).count() <= PIECED:
        return kernels.single(rows, lambda pdf: kernels.trail(pdf, start, directed), schema)
    # trails that take all edges of a part, each one edge of a smaller graph from its first to its last vertex
    at_once = AT_ONCE

    def pieces(frames):
        held, size = [], 0
        for pdf in frames:
            held.append(pdf)
            size += len(pdf)
            if size >= at_once:
                yield kernels.trails(pd.concat(held), directed)
                held, size = [], 0
        if size:
            yield kernels.trails(pd.concat(held), directed)

    few = rows.coalesce(max(2, rows.sparkSession.sparkContext.defaultParallelism))
    parts = store(few.mapInPandas(pieces, f"piece long, at long, eid long, from_id {kind}, to_id {kind}"))
    small = parts.groupBy("piece").agg(F.min_by("from_id", "at").alias("src"), F.max_by("to_id", "at").alias("dst"), F.count(F.lit(1)).alias("size"))
    small = small.withColumns({"eid": F.col("piece"), "ord": F.col("piece")}).drop("piece")

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        order = kernels.trail(pdf, start, directed).merge(pdf[["eid", "size", "src"]], on="eid").sort_values("pos")
        order["first"] = order["size"].cumsum() - order["size"]
        return order.assign(piece=order.eid, back=order.from_id != order.src)[["piece", "first", "size", "back"]]

    order = kernels.single(small, placed, "piece long, first long, size long, back boolean")
    pos = F.col("first") + F.when(F.col("back"), F.col("size") - 1 - F.col("at")).otherwise(F.col("at"))
    ends = [F.when(F.col("back"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("from_id", "to_id"), ("to_id", "from_id"))]
    return parts.join(order, "piece").select(pos.alias("pos"), "eid", *ends)


def _first_end(g: PropertyGraph):
    row = g.edges_with_ords().orderBy(*g.enumeration()).select("src").first()
    return None if row is None else row["src"]


def _empty(g: PropertyGraph) -> DataFrame:
    return g.edges.limit(0).select(F.col("eid").alias("pos"), "eid", F.col("src").alias("from_id"), F.col("dst").alias("to_id"))


def find_eulerian_circuit(g: PropertyGraph) -> DataFrame | None:
    """(pos, eid, from_id, to_id) of a closed trail over every edge, or None."""
    if not has_eulerian_circuit(g):
        return None
    start = _first_end(g)
    return _empty(g) if start is None else _trail(g, start)


def find_eulerian_path(g: PropertyGraph) -> DataFrame | None:
    """(pos, eid, from_id, to_id) of a trail over every edge, or None.

    It starts where more arcs leave, or at the first vertex of uneven degree, or else at the
    first edge.
    """
    if not has_eulerian_path(g):
        return None
    odd = _odd(g).join(g.vertices.select("id", "ord"), "id").orderBy(F.desc("surplus"), "ord").first()
    start = _first_end(g) if odd is None else odd["id"]
    return _empty(g) if start is None else _trail(g, start)
