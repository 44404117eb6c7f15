"""Connected and strongly connected components, condensation, bridges and articulation points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import forests
from ..graph import PropertyGraph
from ..plans.components import star_components
from ..plans.lineage import cut
from ..plans.supersteps import check


def component_ords(g: PropertyGraph, should_stop=None) -> DataFrame:
    """(id, ord, label): label is the smallest ord of the vertex's component, directions ignored."""
    e = g.edges_with_ords().select(F.col("src_ord").alias("u"), F.col("dst_ord").alias("v"))
    found = star_components(e, should_stop=lambda: check(should_stop))
    joined = g.vertices.select("id", "ord").join(found.withColumnRenamed("node", "ord"), "ord", "left")
    return joined.select("id", "ord", F.coalesce("component", "ord").alias("label"))


def connected_components(g: PropertyGraph, should_stop=None) -> DataFrame:
    """(id, component): component is the first vertex, by insertion, of the vertex's component."""
    labels = cut(component_ords(g, should_stop))
    firsts = labels.where("ord = label").select("label", F.col("id").alias("component"))
    return labels.join(firsts, "label").select("id", "component")


def weakly_connected_components(g: PropertyGraph, should_stop=None) -> DataFrame:
    g._directed()
    return connected_components(g, should_stop)


def is_connected(g: PropertyGraph, should_stop=None) -> bool:
    """Whether there is at most one component; the empty graph is connected."""
    return component_ords(g, should_stop).select("label").distinct().limit(2).count() <= 1


def _spread(label: DataFrame, arcs: DataFrame, should_stop) -> DataFrame:
    """Smallest label that reaches each vertex along arcs (src, dst); label is (id, color)."""
    label = cut(label.withColumn("fresh", F.lit(True)))
    while True:
        check(should_stop)
        offers = label.where("fresh").join(arcs, label.id == arcs.src).groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("offer") < F.col("color"))
        label = cut(
            label.join(offers, "id", "left").select("id", F.when(better, F.col("offer")).otherwise(F.col("color")).alias("color"), better.alias("fresh"))
        )
        if label.where("fresh").isEmpty():
            return label.select("id", "color")


def scc_ords(g: PropertyGraph, should_stop=None) -> DataFrame:
    """(id, label): label is the smallest ord of the vertex's strongly connected component.

    Vertices without arcs in or out are components of their own and are trimmed.  Each of the
    others takes the smallest ord that reaches it as its colour; the vertices of a colour that
    its owner's arcs can be walked back to form the owner's component.  They are taken out
    and the rest is coloured again.
    """
    g._directed()
    e = g.edges_with_ords().where("src_ord <> dst_ord").select(F.col("src_ord").alias("src"), F.col("dst_ord").alias("dst")).distinct()
    arcs, done = cut(e), []
    while True:
        check(should_stop)
        count = arcs.count()
        if not count:
            break
        heads, tails = arcs.select(F.col("dst").alias("src")).distinct(), arcs.select(F.col("src").alias("dst")).distinct()
        trimmed = cut(arcs.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        if trimmed.count() < count:
            arcs = trimmed
            continue
        nodes = arcs.select(F.col("src").alias("id")).distinct()
        colors = _spread(nodes.withColumn("color", F.col("id")), arcs, should_stop)
        same = (
            arcs.join(colors.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src")
            .join(colors.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst")
            .where("c1 = c2")
        )
        back = cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("c1").alias("color")))
        seen = frontier = cut(colors.where("id = color"))
        while True:
            check(should_stop)
            step = frontier.join(back.select("src", "dst"), frontier.id == back.src).select(F.col("dst").alias("id"), "color").distinct()
            frontier = cut(step.join(seen.select("id"), "id", "left_anti"))
            if frontier.isEmpty():
                break
            seen = cut(seen.unionByName(frontier))
        done.append(seen.select("id", F.col("color").alias("label")))
        gone = seen.select("id")
        arcs = cut(
            arcs.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
            .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
            .select("src", "dst")
        )
    v = g.vertices.select("id", "ord")
    if not done:
        return v.select("id", "ord", F.col("ord").alias("label"))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return v.join(found.withColumnRenamed("id", "ord"), "ord", "left").select("id", "ord", F.coalesce("label", "ord").alias("label"))


def strongly_connected_components(g: PropertyGraph, should_stop=None) -> DataFrame:
    """(id, component): component is the first vertex, by insertion, of the strong component."""
    labels = cut(scc_ords(g, should_stop))
    firsts = labels.where("ord = label").select("label", F.col("id").alias("component"))
    return labels.join(firsts, "label").select("id", "component")


def condense(g: PropertyGraph, should_stop=None) -> tuple[DataFrame, DataFrame]:
    """((id, component), (src, dst)): component numbers, and the distinct edges between different ones.

    Numbers are in reverse topological order, so every edge runs from a higher to a lower one.
    """
    from . import traversal

    labels = cut(scc_ords(g, should_stop))
    ends = labels.select("id", "label")
    between = (
        g.edges.select("src", "dst")
        .join(ends.select(F.col("id").alias("src"), F.col("label").alias("a")), "src")
        .join(ends.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
        .where("a <> b")
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
        .distinct()
    )
    vertices = labels.select(F.col("label").alias("id")).distinct().withColumn("ord", F.col("id"))
    # equal ends can't occur, so any increasing order of the edges will do
    edges = cut(between.withColumn("ord", F.monotonically_increasing_id()).withColumn("eid", F.col("ord")))
    order = cut(traversal.topological_order(PropertyGraph(vertices, edges), should_stop))
    last = order.count() - 1
    number = order.select(F.col("id").alias("label"), (F.lit(last) - F.col("pos")).cast("int").alias("component"))
    members = labels.join(number, "label").select("id", "component")
    arcs = edges.join(number.select(F.col("label").alias("src"), F.col("component").alias("a")), "src")
    arcs = arcs.join(number.select(F.col("label").alias("dst"), F.col("component").alias("b")), "dst")
    return members, arcs.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _low_links(g: PropertyGraph, should_stop=None) -> DataFrame:
    if g.directed:
        raise ValueError("bridges and articulation points are those of an undirected graph")
    check(should_stop)
    kind = g.vertices.schema["id"].dataType
    integral = kind.simpleString() in ("bigint", "int", "smallint", "tinyint")
    e = g.edges.where("src <> dst")
    if integral:
        found = forests.low_links(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "eid"))
        return cut(found.select("eid", F.col("id").cast(kind).alias("id")))
    ends = g.with_edges(e).edges_with_ords()
    found = cut(forests.low_links(ends.select(F.col("src_ord").alias("a"), F.col("dst_ord").alias("b"), "eid")))
    names = g.vertices.select(F.col("ord").alias("o"), F.col("id").alias("name"))
    return found.join(names, found.id == names.o, "left").select("eid", F.col("name").alias("id"))


def find_bridges(g: PropertyGraph, should_stop=None) -> DataFrame:
    """Edges whose removal disconnects their ends; never one of parallel edges, never a loop."""
    return g.edges.join(_low_links(g, should_stop).where("eid is not null").select("eid"), "eid", "left_semi")


def find_articulation_points(g: PropertyGraph, should_stop=None) -> DataFrame:
    """(id) of vertices whose removal disconnects their component."""
    return _low_links(g, should_stop).where("id is not null").select("id")
