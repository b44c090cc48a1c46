"""The driver's tables as an execution graph: customer -> order -> part -> supplier, and nation -> customer for routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import confidence as C
from ..session import table

# The confidence that an order's priority stands for.
PRIORITY = {"1-URGENT": "observed", "2-HIGH": "resolved", "3-MEDIUM": "candidates", "4-NOT SPECIFIED": "dispatch", "5-LOW": "unobserved"}


def label_of(priority: Column) -> Column:
    return F.coalesce(*[F.when(priority == k, v) for k, v in PRIORITY.items()], F.lit("resolved"))


def edges(spark: SparkSession, sf_dir: str, min_confidence: str | None = None, include_tests: bool = True) -> DataFrame:
    """edge_id, src_key, dst_key, edge_type, confidence, is_test with plain keys `customer:1`; filters are applied before the loops."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if not include_tests:
        lines = lines.where("l_returnflag <> 'R'")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    placed = orders.select(key("customer", "o_custkey").alias("src_key"), key("order", "o_orderkey").alias("dst_key"), F.lit("PLACED").alias("edge_type"), label_of(F.col("o_orderpriority")).alias("confidence"))
    contains = lines.select(key("order", "l_orderkey").alias("src_key"), key("part", "l_partkey").alias("dst_key"), F.lit("CONTAINS").alias("edge_type"), F.lit("resolved").alias("confidence")).distinct()
    supplied = lines.select(key("part", "l_partkey").alias("src_key"), key("supplier", "l_suppkey").alias("dst_key"), F.lit("SUPPLIED_BY").alias("edge_type"), F.lit("resolved").alias("confidence")).distinct()
    every = placed.unionByName(contains).unionByName(supplied)
    if min_confidence is not None:
        every = every.where(C.at_least(F.col("confidence"), min_confidence))
    return every.withColumn("edge_id", F.xxhash64("edge_type", "src_key", "dst_key"))


EDGES_SQL = """
edges AS (
  SELECT 'customer:' || o_custkey AS src_key, 'order:' || o_orderkey AS dst_key, 'PLACED' AS edge_type,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'observed' WHEN '2-HIGH' THEN 'resolved' WHEN '3-MEDIUM' THEN 'candidates'
              WHEN '4-NOT SPECIFIED' THEN 'dispatch' WHEN '5-LOW' THEN 'unobserved' ELSE 'resolved' END AS confidence
  FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', 'resolved' FROM lineitem WHERE {lines}
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY', 'resolved' FROM lineitem WHERE {lines}
), ranked AS (
  SELECT *, CASE confidence WHEN 'observed' THEN 4 WHEN 'resolved' THEN 3 WHEN 'unobserved' THEN 1 ELSE 2 END AS rank FROM edges
)
"""


def edges_sql(include_tests: bool = True) -> str:
    return EDGES_SQL.format(lines="true" if include_tests else "l_returnflag <> 'R'")
