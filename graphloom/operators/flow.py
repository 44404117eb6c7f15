"""Maximum flow and minimum cut."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NegativeWeightError
from ..graph import PropertyGraph
from ..plans.lineage import cut
from ..plans.supersteps import reach
from . import kernels


@dataclass
class MaximumFlowResult:
    """A flow: its value, (eid, src, dst, flow) of every edge but loops, and the least source side of a minimum cut."""

    source: Any
    sink: Any
    flow_value: Any
    edge_flows: DataFrame
    source_side: DataFrame
    min_cut_edges: DataFrame


class MaximumFlowAlgorithm(Protocol):
    """A strategy for maximum flows."""

    def find(self, g: PropertyGraph, source: Any, sink: Any, should_stop=None) -> MaximumFlowResult: ...


class _Augmenting:
    kernel = staticmethod(kernels.shortest_augmenting)

    def __init__(self, capacity: str = "weight"):
        self.capacity = capacity

    def find(self, g: PropertyGraph, source: Any, sink: Any, should_stop=None) -> MaximumFlowResult:
        """The kernel sees only edges on the way: reached from the source and reaching the sink.

        The cut is searched in the whole graph's residual, so it holds every vertex that the
        source still reaches, dead ends included.
        """
        g._directed()
        g._known(source)
        g._known(sink)
        if source == sink:
            raise ValueError("source and sink must differ")
        capacity = F.col(self.capacity)
        if not g.edges.where((capacity < 0) | capacity.isNull()).isEmpty():
            raise NegativeWeightError("capacities must not be negative")
        edges = cut(g.edges.where("src <> dst").select("eid", "src", "dst", "ord", capacity.alias("capacity")))
        kind = edges.schema["capacity"].dataType.simpleString()
        open_arcs = edges.where("capacity > 0").select("src", "dst")
        ahead = reach(g.vertices.where(F.col("id") == F.lit(source)), open_arcs, should_stop).select("id")
        back = reach(g.vertices.where(F.col("id") == F.lit(sink)), open_arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), should_stop)
        way = cut(ahead.join(back.select("id"), "id", "left_semi"))
        inner = edges.where("capacity > 0").join(way.withColumnRenamed("id", "src"), "src", "left_semi").join(way.withColumnRenamed("id", "dst"), "dst", "left_semi")
        kernel = self.kernel
        solved = cut(kernels.single(inner, lambda pdf: kernel(pdf, source, sink), f"eid long, flow {kind}"))
        flows = cut(edges.join(solved, "eid", "left").withColumn("flow", F.coalesce("flow", F.lit(0).cast(kind))))
        rest = flows.where("flow < capacity").select("src", "dst").unionByName(flows.where("flow > 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        side = reach(g.vertices.where(F.col("id") == F.lit(source)), cut(rest), should_stop).select("id")
        out, into = F.col("src") == F.lit(source), F.col("dst") == F.lit(source)
        value = flows.agg(F.sum(F.when(out, F.col("flow")).when(into, -F.col("flow")))).first()[0] or 0
        crossing = flows.join(side.withColumnRenamed("id", "src"), "src", "left_semi").join(side.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return MaximumFlowResult(
            source, sink, value, flows.select("eid", "src", "dst", "flow"), side, crossing.select("eid", "src", "dst", "capacity")
        )


class EdmondsKarp(_Augmenting):
    """Shortest augmenting paths."""


class Dinic(_Augmenting):
    """Blocking flows in level graphs."""

    kernel = staticmethod(kernels.blocking_flows)


def maximum_flow(g: PropertyGraph, source: Any, sink: Any, capacity: str = "weight", should_stop=None) -> MaximumFlowResult:
    return EdmondsKarp(capacity).find(g, source, sink, should_stop)
