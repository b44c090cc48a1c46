"""Counters and windows over event streams, and an idempotent change feed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import shared_dir


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream with the schema of the table; new files become new batches."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).format("parquet").option("recursiveFileLookup", "true").load(f"{folder}/{name}.parquet*")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now (AvailableNow) and returns the result as a table of the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        def put(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def live_counters(events: DataFrame, run: str, category: Column, amount: Column, at: str | None = None, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Sum and number of events for each run and category. The state is one row for each of these; with a time column they are counted for windows of `width`, so
    that windows older than the watermark leave the state (in append or update mode)."""
    if at is None:
        return events.groupBy(run, category.alias("category")).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))
    found = events.withWatermark(at, late).groupBy(F.window(at, width), run, category.alias("category")).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), run, "category", "total", "n")


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], *aggs: Column, late: str = "10 minutes") -> DataFrame:
    found = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(*aggs)
    return found.select("window.start", "window.end", *[c for c in found.columns if c != "window"])


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Session windows of each key with the number of events."""
    found = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the whole versions of a change feed, the newest last. A version counts from the moment its writer has committed it, so no pointer has to be replaced."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n[1:].isdigit() and n[0] == "v" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")))


def apply_batch(batch: DataFrame, batch_id: int, target: str, key: str, digest: str, order: str | None = None) -> None:
    """Writes version `batch_id` of a table: the last version before it without the batch's keys, and the last row of each key of the batch by `order` (then by digest); a row whose
    digest is null only deletes. A batch that is run again starts from the same older version and writes the same rows."""
    spark = batch.sparkSession
    rank = F.struct(*([order] if order else []), F.coalesce(F.col(digest), F.lit("")))
    last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), rank).alias("row")).select("row.*")
    fresh = last.where(F.col(digest).isNotNull())
    if before := [n for n in versions(spark, target) if n < batch_id]:
        fresh = spark.read.parquet(f"{target}/v{before[-1]}").join(last.select(key), key, "left_anti").select(*batch.columns).unionByName(fresh)
    fresh.write.mode("overwrite").parquet(f"{target}/v{batch_id}")
    for old in before[:-1]:  # the one before stays, for a batch that is run again and for readers
        spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v{old}"), True)


def change_feed(stream: DataFrame, target: str, key: str, checkpoint: str, digest: str, order: str | None = None):
    """Starts a query that keeps the table in `target` equal to the last row of each key: each batch deletes its keys and inserts its rows (see apply_batch). The table is rewritten by each batch, so batches should be few and large."""
    put = lambda batch, batch_id: apply_batch(batch, batch_id, target, key, digest, order)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The newest whole version of a change feed."""
    return spark.read.parquet(f"{target}/v{versions(spark, target)[-1]}")
