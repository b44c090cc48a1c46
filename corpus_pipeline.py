"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and gives the documents that go on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from graphloom.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic; the model learns from `labels` and the documents given. Null and empty texts are scored like others, repeated rows go or stay together, an empty table
    gives an empty one, and without labels nothing goes."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable()))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id; of repeated rows one. Null texts count as empty, so one of all null and empty ones stays; null ids come last."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), the smallest id. Null and empty texts and rows without id stay; rows of one id go or stay together."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item to 60 % of its words, or a whole item of fewer than five words. Null and empty texts stay; null items count for nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every row; null and empty texts have no tokens."""
    return bpe.encode_texts(docs, *bpe.public_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: A fitted model and similarities of all pairs: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what each stage returns is written as Parquet to the shared folder and read again by the next."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
