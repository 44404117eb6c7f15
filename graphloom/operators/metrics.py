"""Distance metrics of connected graphs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DisconnectedGraphError, NegativeWeightError
from ..functions import fanout
from ..graph import PropertyGraph
from ..plans.lineage import cut


def _summaries(g: PropertyGraph, weight: str | None, should_stop=None) -> tuple[DataFrame, int]:
    """((id, reached, total, furthest), vertices), checked to be connected and non-negative."""
    v, arcs = fanout.numbered(g, weight)
    n = v.count()
    if not n:
        raise DisconnectedGraphError("the graph is empty")
    if weight is not None and not arcs.where("w < 0").isEmpty():
        raise NegativeWeightError("distances need non-negative weights")
    found = cut(fanout.summaries(v, arcs, weight is not None, should_stop))
    if found.agg(F.min("reached")).first()[0] < n:
        raise DisconnectedGraphError("some vertex does not reach every other")
    return found.join(v, found.s == v.n).select("id", "reached", "total", "furthest"), n


def eccentricities(g: PropertyGraph, weight: str | None = None, should_stop=None) -> DataFrame:
    """(id, eccentricity): the greatest distance from each vertex."""
    return _summaries(g, weight, should_stop)[0].select("id", F.col("furthest").alias("eccentricity"))


def eccentricity(g: PropertyGraph, v: Any, weight: str | None = None, should_stop=None):
    """The greatest distance from one vertex; every vertex must reach every other."""
    from . import connectivity, paths

    g._known(v)
    connected = connectivity.is_connected(g) if not g.directed else connectivity.scc_ords(g).select("label").distinct().count() == 1
    if not connected:
        raise DisconnectedGraphError("some vertex does not reach every other")
    return paths.shortest_paths_from(g, v, weight, should_stop).rows.agg(F.max("distance")).first()[0]


def diameter(g: PropertyGraph, weight: str | None = None, should_stop=None):
    return _summaries(g, weight, should_stop)[0].agg(F.max("furthest")).first()[0]


def radius(g: PropertyGraph, weight: str | None = None, should_stop=None):
    return _summaries(g, weight, should_stop)[0].agg(F.min("furthest")).first()[0]


def _at(g: PropertyGraph, weight: str | None, which, should_stop) -> DataFrame:
    rows, _ = _summaries(g, weight, should_stop)
    return rows.join(F.broadcast(rows.agg(which("furthest").alias("bound"))), F.col("furthest") == F.col("bound")).select("id")


def center(g: PropertyGraph, weight: str | None = None, should_stop=None) -> DataFrame:
    """(id) of the vertices whose eccentricity is the radius."""
    return _at(g, weight, F.min, should_stop)


def periphery(g: PropertyGraph, weight: str | None = None, should_stop=None) -> DataFrame:
    """(id) of the vertices whose eccentricity is the diameter."""
    return _at(g, weight, F.max, should_stop)


def average_path_length(g: PropertyGraph, weight: str | None = None, should_stop=None) -> float:
    """Mean distance over ordered pairs of different vertices; 0 for a single vertex."""
    rows, n = _summaries(g, weight, should_stop)
    if n < 2:
        return 0.0
    return float(rows.agg(F.sum(F.col("total").cast("double"))).first()[0]) / (n * (n - 1))
