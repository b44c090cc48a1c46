"""Helpers that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Python workers started elsewhere than in the repository find this package too (local mode; a cluster has it installed)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch between the JVM and Python. Texts can be long, and a batch is held on both sides.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches have been limited to BATCH_ROWS rows, if they were larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the one in spark.checkpoint.dir, or where that is unset, in local mode only (tests), a temporary one that goes at the end."""
    if (told := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return told
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, so that a lost executor costs a re-read and not a re-run."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(column: str, mod: int):
    """crc32 of the value as text, modulo `mod`; null stays null."""
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % mod


def unused(df: DataFrame, name: str = "found") -> str:
    """A column name that df doesn't have, whatever the case of its names."""
    held = {c.lower() for c in df.columns}
    while name in held:
        name += "_"
    return name


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df with its keys passed through explode, which hides how it is partitioned.

    What an aggregate gives is already partitioned by its key, so a join on it would reuse that and could not be split. Joined as `apart`, both sides are shuffled for
    the join alone, and adaptive execution deals the rows of a hot key on the other side over many tasks.
    """
    for key in keys:
        df = df.select(*[c for c in df.columns if c != key], F.explode(F.array(key)).alias(key))
    return df


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle, for exchanges whose rows cost much more than their bytes tell."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star contraction, a distributed union-find.

    edges: columns a, b (bigint, no nulls; direction and repeats don't matter). Returns node, component (the smallest node reachable) for
    every node with an edge to another node. The minimum of a neighbourhood is an aggregate with map-side combine. It is joined back as `apart`, so adaptive execution can
    split the neighbours of a hub over tasks. Every round is checkpointed; it stops when the set of edges no longer
    changes and then each remaining edge joins a node to the smallest of its component. The number of rounds grows with the logarithm of the longest path. An empty table gives an empty one.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("edge")).select("edge.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(apart(least, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(apart(low, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        mark_now = mark(now)
        if mark_now == seen:
            break
        seen = mark_now
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component")).distinct()


def open_groups(clusters: DataFrame, rest: DataFrame, member: DataFrame, block: int) -> DataFrame:
    """What is left to compare in clusters of candidates, after every node has been compared with the lead of its cluster (the smallest node).

    clusters: node, component. rest: node, those that aren't similar to their lead. member: node, bucket, from which the clusters come. Nodes that are similar to the lead are
    joined already, so only pairs with a node of the rest matter. They are found within the whole cluster (part 0), or, where that is dearer, in its
    buckets: a chain of buckets can tie very many nodes that never met in one, but two similar nodes share a bucket. Buckets with the same members count once.

    Returns component, part, node, rest; only groups of three or more nodes or without the lead, with one of the rest.
    """
    flagged = clusters.join(rest.select("node", F.lit(1).alias("rest")), "node", "left").fillna(0, ["rest"])
    sizes = flagged.groupBy("component").agg(F.count("*").alias("n"), F.sum("rest").alias("r")).where("r > 0 and n > 2")
    left = cut(flagged.join(apart(sizes, "component"), "component"))
    whole = left.select("component", F.lit(0).cast("bigint").alias("part"), "node", "rest")
    if left.where(F.col("n") > block).isEmpty():
        return whole
    met = left.where(F.col("n") > block).join(member, "node")
    node = F.col("node")
    sets = met.groupBy("component", "bucket").agg(F.count("*").alias("m"), F.sum("rest").alias("s"), F.bit_xor(F.xxhash64(node)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), node)).alias("y"), F.first("n").alias("n"), F.first("r").alias("r"))
    once = sets.where("m > 1 and s > 0").groupBy("component", "m", "s", "x", "y").agg(F.min("bucket").alias("bucket"), F.first("n").alias("n"), F.first("r").alias("r"))
    real = lambda a, b: F.col(a).cast("double") * F.col(b)
    cheap = once.groupBy("component").agg(F.sum(real("m", "s")).alias("price"), F.first(real("n", "r")).alias("all")).where("price < all").select("component")
    chosen = once.join(cheap, "component").select("component", "bucket")
    parts = met.join(apart(chosen, "component", "bucket"), ["component", "bucket"]).select("component", F.col("bucket").alias("part"), "node", "rest")
    return cut(whole.join(cheap, "component", "left_anti").unionByName(parts))


def deal(groups: DataFrame, count: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """groups (component, part, node, rest, ...) with block, own and blocks: a group's rest is dealt into blocks 0 to own - 1 and its other nodes into own to blocks - 1, of about `count` nodes,
    or `most` of `weight`, at most. The pairs to compare are those of blocks i < own and j >= i."""
    held = lambda rest: F.ceil(F.greatest(F.sum(F.when(F.col("rest") == rest, 1)) / count, F.sum(F.when(F.col("rest") == rest, F.col(weight) if weight else 0)) / most))
    sizes = groups.groupBy("component", "part").agg(held(1).alias("own"), F.coalesce(held(0), F.lit(0)).alias("others"))
    joined = groups.join(apart(sizes, "component", "part"), ["component", "part"])
    at = lambda n: F.pmod(F.xxhash64(F.lit(3), "node"), F.greatest(F.col(n), F.lit(1)))
    return joined.withColumn("block", F.when(F.col("rest") == 1, at("own")).otherwise(F.col("own") + at("others"))).withColumn("blocks", F.col("own") + F.col("others")).drop("others")
