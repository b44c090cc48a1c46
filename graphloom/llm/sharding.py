"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import apart, cut, table

#: Bits of a size class: groups of one class differ in size by less than 1 in 2**BITS. Parts that ranks and slots are counted in.
BITS, PARTS = 10, 1024
#: Most rows that are sent to every task.
BROADCAST = 200_000


def schedule(classes: list[tuple[float, int]], shards: int) -> Iterator[list[int]]:
    """For classes (size of a group, number of groups), the largest size first: how many of its groups each shard gets.

    The heap holds the shards by load and each group goes to the least loaded one, the lowest number of a tie. Many groups of one size are first poured up to a common
    level, which is where the heap would take them, so the work does not grow with the number of groups.
    """
    load = [0.0] * shards
    for size, count in classes:
        given = [0] * shards
        if count > 4 * shards:
            low, high = min(load), max(load) + size * count
            for _ in range(80):
                level = (low + high) / 2
                if sum(int((level - x) // size) for x in load if x < level) <= count - shards:
                    low = level
                else:
                    high = level
            given = [int((low - x) // size) if x < low else 0 for x in load]
            load = [x + size * n for x, n in zip(load, given, strict=True)]
        heap = [(x, k) for k, x in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(count - sum(given)):
            x, k = heapq.heappop(heap)
            given[k] += 1
            heapq.heappush(heap, (x + size, k))
        for x, k in heap:
            load[k] = x
        yield given


def _rank(df: DataFrame, by: list[str], tie: list[str], salt, name: str, small: bool) -> DataFrame:
    """Adds the gapless place of each row among those with equal `by`, from 0. Rows are counted in PARTS parts of a hash, so no task holds a whole `by`."""
    parted = df.withColumn("part", F.pmod(salt, F.lit(PARTS)).cast("int"))
    counts = parted.groupBy(*by, "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy(*by, "part").orderBy(*tie)
    joined = parted.withColumn("own", F.row_number().over(own)).join(F.broadcast(starts) if small else starts, [*by, "part"])
    return joined.withColumn(name, F.col("start") + F.col("own") - 1).drop("part", "own", "start")


def lpt_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Puts documents into shards of nearly equal bytes; documents of equal text share a shard.

    A document counts the UTF-8 bytes of its text (null: none) and `overhead`. Groups of equal texts (a null text counts as empty) are sorted by size, the largest first, and each goes to the
    least loaded shard through a heap. Sizes are taken as classes of BITS significant bits, at their mean; so the driver sees one row a class, at most 2**BITS for
    each power of two, however many groups there are, and single large groups have their exact size. Within a class sizes differ by less than 1 in 2**BITS, so the heap's view of a shard's
    load, and with it the level that plain scheduling would reach, is off by less than 1 in 2**BITS. A group finds its shard from its rank in its class. The starts that are
    broadcast are PARTS rows a shard, and are shuffled instead beyond BROADCAST rows.

    Returns id, size, text_crc32 (unsigned; 0 for null), shard (from 0), slot (gapless from 0 in each shard). Ids may be null or repeated; every row gets a slot of its own.
    Shards can be unequal only by a group larger than an equal share. An empty table gives an empty one; other columns are ignored.
    """
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    drop = F.greatest(F.lit(0), F.length(F.bin("bytes")) - BITS - 1)
    groups = cut(groups.withColumn("scale", drop).withColumn("class", F.expr("shiftright(bytes, scale)")))
    found = groups.groupBy("scale", "class").agg(F.avg("bytes").alias("mean"), F.count("*").alias("n")).orderBy(F.desc("mean")).collect()
    bounds = []
    for row, given in zip(found, schedule([(r.mean, r.n) for r in found], shards), strict=True):
        ends, at = [], 0
        for n in given:
            at += n
            ends.append(at)
        bounds.append((row.scale, row["class"], ends))
    plan = docs.sparkSession.createDataFrame(bounds, "scale int, class bigint, ends array<bigint>")
    ranked = _rank(groups, ["scale", "class"], ["key"], F.xxhash64("key"), "rank", small=False)
    placed = ranked.join(F.broadcast(plan) if len(bounds) * shards <= BROADCAST else plan, ["scale", "class"]).select("key", F.size(F.filter("ends", lambda end: end <= F.col("rank"))).alias("shard"))
    sharded = cut(rows.join(apart(placed, "key"), "key").select("id", "size", "text_crc32", "shard"))
    return _rank(sharded, ["shard"], ["id", "text_crc32"], F.xxhash64("id", "text_crc32", "size"), "slot", small=shards * PARTS <= BROADCAST)


def op9_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards by the law `bytes`, one row each; a null text counts 16 bytes, equal texts share a shard, repeated rows get slots of their own."""
    placed = lpt_shards(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
