"""Graphs derived from the driver's tables, and the same graphs as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blocks import tally
from ..graph import PropertyGraph, in_order
from ..hypergraph import Hypergraph
from ..plans.lineage import cut, discard, passing, store

#: Ids below which an edge's order is made of both its ends.
PAIRED = 1 << 29


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_flow(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Supplier nation -> customer nation through orders; weight is the number of lines. Directed, with loops."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("src"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dst"))
    rows = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(orders, line.l_orderkey == orders.o_orderkey)
    rows = rows.join(customer, rows.o_custkey == customer.c_custkey).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return PropertyGraph.from_dataframes(
        rows.withColumn("ord", F.col("src") * 1000 + F.col("dst")), nation.withColumn("ord", F.col("id")), True, False
    ).freeze()


NATION_FLOW = """
nv AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation),
ne AS (
    SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(count(*) AS BIGINT) AS weight
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY 1, 2
)"""


def event_flow(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Each user's consecutive event types. A directed multigraph."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("src"))
    rows = e.withColumn("dst", F.lead("src").over(Window.partitionBy("user_id").orderBy("ts"))).where("dst is not null")
    return PropertyGraph.from_dataframes(rows.select("src", "dst", F.col("event_id").alias("ord")), None, True, True).freeze()


EVENT_FLOW = """
ee AS (
    SELECT * FROM (
        SELECT event_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS dst FROM events
    ) WHERE dst IS NOT NULL
)"""


def supp_part(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Suppliers and the parts they ship, ids tagged. Undirected and bipartite."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    rows = rows.select(F.concat(F.lit("s:"), "l_suppkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst"))
    edges = store(in_order(rows, F.col("src"), F.col("dst"))).withColumn("eid", F.col("ord"))
    # pairs are distinct and run one way
    g = PropertyGraph.from_dataframes(edges, None, False, True)
    return PropertyGraph(cut(g.vertices), g.edges, False, False)


SUPP_PART = """
se AS (SELECT DISTINCT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst FROM lineitem)"""


def copurchase(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """Orders as hyperedges over their parts."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hid"), F.col("l_partkey").alias("v"))
    return Hypergraph.from_dataframe(rows)


def lines(spark: SparkSession, sf_dir: str, least: int | None) -> DataFrame:
    """The lines of at least that quantity; all of them if it is None."""
    line = table(spark, sf_dir, "lineitem")
    return line if least is None else line.where(F.col("l_quantity") >= least)


def copurchase_pairs(spark: SparkSession, sf_dir: str, least: int | None) -> PropertyGraph:
    """Parts in one order, both in lines of at least that quantity (None: any). Undirected; parts without a pair are left out."""
    line = lines(spark, sf_dir, least).select("l_orderkey", "l_partkey")
    a, b = line.withColumnRenamed("l_partkey", "src"), line.withColumnRenamed("l_partkey", "dst")
    rows = a.join(b, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return _stored(rows, False)


def _stored(rows: DataFrame, directed: bool) -> PropertyGraph:
    """The graph of distinct pairs (src, dst, ...) of ids in order of (src, dst), stored; undirected pairs have src < dst."""
    rows = store(rows.sortWithinPartitions("src", "dst"))
    with passing(rows.sparkSession):
        ids = cut(tally(rows, ["src", "dst"]).select(F.col("id").cast(rows.schema["src"].dataType).alias("id"), F.col("id").alias("ord")))
    ends = ids.agg(F.min("id"), F.max("id")).first()
    if ends[0] is None or (ends[0] >= 0 and ends[1] < PAIRED):
        edges = rows.withColumn("ord", F.shiftleft("src", 31) + F.col("dst"))
    else:
        edges = store(in_order(rows, F.col("src"), F.col("dst")))
        discard(rows)
    return PropertyGraph(ids, edges.withColumn("eid", F.col("ord")), directed, False)


def copurchase_sql(least: int) -> str:
    return f"""
cl AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= {least}),
ce AS (
    SELECT a.l_partkey AS src, b.l_partkey AS dst, CAST(count(*) AS BIGINT) AS weight
    FROM cl a JOIN cl b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2
),
cv AS (SELECT src AS id FROM ce UNION SELECT dst FROM ce),
ca AS (SELECT src, dst, weight FROM ce UNION ALL SELECT dst, src, weight FROM ce)"""


def part_seq(spark: SparkSession, sf_dir: str, least: int | None = 40) -> PropertyGraph:
    """The next part inside an order, among lines of at least that quantity (None: any). Directed, with cycles."""
    line = lines(spark, sf_dir, least)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = line.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()
    return _stored(rows, True)


def part_seq_sql(least: int = 40) -> str:
    return f"""
pe AS (
    SELECT DISTINCT src, dst FROM (
        SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst
        FROM lineitem WHERE l_quantity >= {least}
    ) WHERE dst IS NOT NULL AND src <> dst
),
pv AS (SELECT src AS id FROM pe UNION SELECT dst FROM pe)"""


def conv_chain(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Each turn of a conversation to the next; weight is the next text's length. A forest of paths."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max(F.length("text")).cast("long").alias("size"))
    t = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "size")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst"), F.lead("size").over(w).alias("weight")).where("dst is not null")
    ids = t.select("id", F.col("id").alias("ord"))
    return PropertyGraph.from_dataframes(rows.withColumn("ord", F.col("src")), ids, True, False).freeze()


CONV_CHAIN = """
tt AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, max(length(text)) AS size FROM conversations GROUP BY conv_id, turn),
te AS (
    SELECT * FROM (
        SELECT id AS src, lead(id) OVER w AS dst, CAST(lead(size) OVER w AS BIGINT) AS weight FROM tt WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    ) WHERE dst IS NOT NULL
)"""


def geo_tree(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Region -> nation -> customer -> order, numbered by kind. A directed tree of depth 3 for each region."""
    nation = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    customer = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("src"), (F.col("c_custkey") + (1 << 32)).alias("dst"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") + (1 << 32)).alias("src"), (F.col("o_orderkey") + (1 << 40)).alias("dst"))
    rows = nation.unionByName(customer).unionByName(orders).withColumn("ord", F.col("dst"))
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_regionkey").cast("long").alias("ord"))
    return PropertyGraph.from_dataframes(rows, region, True, False).freeze()


GEO_TREE = f"""
ge AS (
    SELECT CAST(n_regionkey + 1 AS BIGINT) AS src, CAST(n_nationkey + 100 AS BIGINT) AS dst FROM nation
    UNION ALL SELECT CAST(c_nationkey + 100 AS BIGINT), c_custkey + {1 << 32} FROM customer
    UNION ALL SELECT o_custkey + {1 << 32}, o_orderkey + {1 << 40} FROM orders
)"""
