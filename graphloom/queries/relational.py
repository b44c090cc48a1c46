"""Queries of categories that Spark has of itself: joins, sets, sorts, grouping sets, windows, approximate counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

#: Most rows of a side that is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows, counted, are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    price, net = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


PRICING_SQL = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL"


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("nth", F.row_number().over(w)).where("nth <= 5").select("o_orderpriority", "nth", "o_orderkey")


def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").rollup("p_type", "p_brand").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("graphloom_events")
    return spark.sql("SELECT event_type, user_id, count(*) AS n FROM graphloom_events GROUP BY GROUPING SETS ((event_type), (user_id), ())")


def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def broadcast_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and region: the fact table is read once, dimensions of checked size are sent to it."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = table(spark, sf_dir, "supplier").join(small(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(small(region), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    return lines.join(small(dim), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


STAR_SQL = "SELECT r_name, n_name, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL"


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of errors and purchases of a user within half an hour: both sides are put into half-hour bins, so it is an equi-join on (user, bin) with a residual."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    width = 1_800_000_000
    a = ev.where("event_type = 'error'").select(F.col("event_id").alias("error"), "user_id", "at", F.explode(F.array(F.floor(F.col("at") / width), F.floor(F.col("at") / width) + 1)).alias("bin"))
    b = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("at").alias("then"), F.floor(F.col("at") / width).alias("bin"))
    return a.join(b, ["user_id", "bin"]).where((F.col("then") >= F.col("at")) & (F.col("then") <= F.col("at") + width)).select("error", "purchase")


RANGE_SQL = "SELECT a.event_id AS error, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'error' AND b.event_type = 'purchase'"


def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.lag("o_orderkey").over(by).alias("before"), F.lead("o_orderkey").over(by).alias("after"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")).alias("status_rank"), F.round(F.sum("o_totalprice").over(by.rowsBetween(-2, 0)), 2).alias("last_three"), F.ntile(4).over(by).alias("quarter"))


FRAMES_SQL = """SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS status_rank, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three, CAST(ntile(4) OVER w AS INTEGER) AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimate of distinct users by event type is within a tenth of the exact number."""
    ev = table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("exact"))
    return ev.select("event_type", "exact", (F.abs(F.col("a") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 5).alias("norm"), F.max(F.size("embedding")).alias("dims"))


NORM_SQL = "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS norm, CAST(max(len(embedding)) AS INTEGER) AS dims FROM embeddings GROUP BY label"

QUERIES = {
    "pricing_summary": pricing_summary, "topk": topk, "topk_per_group": topk_per_group, "set_union": set_union, "set_intersect_all": set_intersect_all, "set_except_all": set_except_all, "rollup": rollup, "cube": cube,
    "grouping_sets": grouping_sets, "semi_join": semi_join, "anti_join": anti_join, "broadcast_star_join": broadcast_star_join, "range_join": range_join, "window_frames": window_frames, "approx_distinct": approx_distinct, "pivot": pivot, "embedding_norms": embedding_norms,
}
ORACLE = {
    "pricing_summary": PRICING_SQL, "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topk_per_group": "SELECT o_orderpriority, CAST(nth AS INTEGER) AS nth, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth <= 5",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "rollup": "SELECT p_type, p_brand, count(*) AS n, CAST(grouping(p_type, p_brand) AS BIGINT) AS level FROM part GROUP BY ROLLUP (p_type, p_brand)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())",
    "semi_join": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "broadcast_star_join": STAR_SQL, "range_join": RANGE_SQL, "window_frames": FRAMES_SQL, "approx_distinct": "SELECT event_type, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY event_type",
    "pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority",
    "embedding_norms": NORM_SQL,
}
