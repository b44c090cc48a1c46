"""Traces, transcripts, telemetry rows and snapshots."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_timestamp

TRACE = "version int, recorded_at string, files map<string,string>, edges array<struct<`from`:struct<file:string,`function`:string,class:string>,`to`:struct<file:string,`function`:string,class:string>,test:string,count:bigint>>"
STEP = "session_id string, step_idx int, type string, source string, content string, created_at string, tool_calls string"


def load_trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (src_file, src_function, src_class, dst_..., test, count) and file digests of a recorded trace."""
    raw = spark.read.schema(TRACE).option("multiLine", "true").json(path)
    edges = raw.select(F.explode("edges").alias("e")).select(*[F.col(f"e.{a}.{c}").alias(f"{b}_{c}") for a, b in (("from", "src"), ("to", "dst")) for c in ("file", "function", "class")], "e.test", "e.count")
    return edges, raw.select(F.explode("files").alias("file", "sha256"))


def stale_edges(edges: DataFrame, recorded: DataFrame, now: DataFrame) -> DataFrame:
    """edges with `stale`: an end's file has another digest now than when the trace was recorded, or is gone."""
    changed = recorded.join(now.select("file", F.col("sha256").alias("__now")), "file", "left").where(~F.col("sha256").eqNullSafe(F.col("__now"))).select("file")
    a = changed.select(F.col("file").alias("src_file"), F.lit(True).alias("__a"))
    b = changed.select(F.col("file").alias("dst_file"), F.lit(True).alias("__b"))
    return edges.join(a, "src_file", "left").join(b, "dst_file", "left").withColumn("stale", F.coalesce("__a", "__b", F.lit(False))).drop("__a", "__b")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Steps of agent transcripts (JSON lines); lines that don't parse are left out; created_at in any of three ISO forms; tool calls kept as JSON."""
    raw = spark.read.schema(STEP).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("created_at", iso_timestamp(F.col("created_at"))).where("type is not null")


def tool_arguments(steps: DataFrame) -> DataFrame:
    """One row per tool call: name and arguments as a map, whether they came as an object or as a JSON string."""
    calls = steps.select("session_id", "step_idx", F.explode(F.from_json("tool_calls", "array<struct<name:string,args:string>>")).alias("c"))
    text = F.when(F.startswith("c.args", F.lit('"')), F.from_json(F.concat(F.lit('{"v":'), "c.args", F.lit("}")), "v string")["v"]).otherwise(F.col("c.args"))
    return calls.select("session_id", "step_idx", "c.name", F.from_json(text, "map<string,string>").alias("args"))


def log_rows(rows: DataFrame, path: str) -> None:
    """Appends telemetry rows."""
    rows.write.mode("append").parquet(path)


def save_snapshot(tables: dict[str, DataFrame], path: str) -> str:
    """Writes all sections into a new version and only then the pointer that readers follow, so a broken write is never read."""
    version = f"v{time.time_ns()}"
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return version


def has_snapshot(spark: SparkSession, path: str) -> bool:
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    return pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer)


def load_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/current').first().value}/{name}")
