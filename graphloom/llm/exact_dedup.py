"""Exact deduplication by a content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, tasks

#: Least number of runs that a text with very many copies is cut into; there are as many as the session has shuffle partitions.
SALTS = 64


def sorted_runs(docs: DataFrame, id_col: str, text: Column, payload: Column | None = None) -> DataFrame:
    """Runs of equal texts, found by a range-partitioned external sort of the normalised bytes.

    Splitters are sampled over (first bytes, digest, salt), so that what the sampler sends to the driver is small however long the texts are; equal
    texts have equal keys and end up adjacent. Within a range the rows are sorted on the whole text, which Spark does externally, and a
    window breaks where neighbouring whole texts differ. The salt comes from the identifier and cuts a text with very many copies into up to
    SALTS runs, or one for each shuffle partition, so a third of the table may be one text. Null texts count as empty.

    Returns id, salt, text_sha256, nth (place in the run, from the largest id on, null ids last), in_run (rows of the run) and payload.
    """
    more = [payload.alias("payload")] if payload is not None else []
    salts = max(SALTS, tasks(docs.sparkSession))
    bare = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("t"), *more)
    keyed = bare.select(
        "*", F.substring(F.encode("t", "UTF-8"), 1, 32).alias("head"), F.xxhash64("t").alias("digest"),
        F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(salts)).alias("salt"),
    )
    run = Window.partitionBy("head", "digest", "salt", "t").orderBy(F.col("id").desc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = keyed.repartitionByRange("head", "digest", "salt").withColumns({"nth": F.row_number().over(run), "in_run": F.count(F.lit(1)).over(whole)})
    return placed.select("id", "salt", F.sha2(F.encode("t", "UTF-8"), 256).alias("text_sha256"), "nth", "in_run", *(["payload"] if more else []))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lambda c: c) -> DataFrame:
    """The group of equal texts of every row of docs. normalise: from the text's column to the one that is compared.

    Returns one row per row of docs: id, keep_id (largest id of the group; null when all its ids are null), group_size, kept (true for one row of each
    group; of repeated rows with the largest id exactly one), text_sha256 of the normalised text. Null texts count as empty, other columns are ignored, an empty
    table gives an empty one. The sort is done once: its narrow result is checkpointed, and the runs of a text meet by their digests (SHA-256), as one row a run,
    and each run gets the answer for itself by digest and salt, so no task holds all copies of a text.
    """
    runs = cut(sorted_runs(docs, id_col, normalise(F.col(text_col))))
    same = Window.partitionBy("text_sha256")
    best = F.row_number().over(same.orderBy(F.col("id").desc_nulls_last(), "salt"))
    heads = runs.where("nth = 1").select("text_sha256", "salt", F.max("id").over(same).alias("keep_id"), F.sum("in_run").over(same).alias("group_size"), (best == 1).alias("first"))
    return runs.join(heads, ["text_sha256", "salt"]).select("id", "keep_id", "group_size", ((F.col("nth") == 1) & F.col("first")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lambda c: c) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest id; all columns stay, whatever their names.

    Only the first row of each run goes on to the second step, so a text meets itself at most once a salt there. Null texts count as empty, rows without id go before others of their text, an empty table gives an empty one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    firsts = sorted_runs(docs, id_col, normalise(F.col(text_col)), whole).where("nth = 1").select("id", "salt", "text_sha256", "payload")
    best = Window.partitionBy("text_sha256").orderBy(F.col("id").desc_nulls_last(), "salt")
    return firsts.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("payload.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, compared without any change."""
    return exact_dedup(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
