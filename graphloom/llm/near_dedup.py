"""MinHash near-deduplication: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketching as S
from .common import apart, components, cut, deal, open_groups, small_batches, table, tasks, unused

#: Rows of a band.
ROWS = 8
#: Largest chance that a pair just at the threshold shares no band.
MISS = 1e-5
#: Most documents, and most bytes of their texts, of one block of a candidate cluster.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Documents of a cluster from which on comparing all its blocks with each other is avoided.
LARGE = 100 * BLOCK


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def _sketch(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch, "t"):
                data, offsets = S.string_buffers(part.column("t"))
                row, value = S.distinct(*_shingles(data, offsets, k)[::-1])
                n = len(part)
                size = np.bincount(row, minlength=n)
                with np.errstate(over="ignore"):
                    key = [np.zeros(n, np.uint64) for _ in range(2)]
                    for j in range(2):
                        np.add.at(key[j], row, S.mix(value + S.U(j + 1) * S.MIX_A))
                    sketch = S.fast_similarity_sketch(row, value, n, bands * ROWS).reshape(n, bands, ROWS)
                    bucket = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                    for j in range(ROWS):
                        bucket = S.mix(bucket * S.BASE + sketch[:, :, j])
                flat = pa.array(bucket.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(size.astype(np.int64)), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), flat)],
                    names=["id", "n", "k0", "k1", "bytes", "buckets"],
                )

    return run


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return S.shingle_hashes(*S.word_hashes(data, offsets), k)


def common_counts(row: np.ndarray, value: np.ndarray, rows: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets in `left` with those in `right`, by products of 0/1 matrices over pieces of the vocabulary."""
    _, code, held = np.unique(value, return_inverse=True, return_counts=True)
    shared = held[code] > 1
    row, code = row[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    total = np.zeros((len(left), len(right)), np.int64)
    width = max(256, (4 << 20) // max(1, rows))
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [at, at + width])
        there = np.zeros((rows, min(width, int(code[-1]) + 1 - at)), np.float32)
        there[row[lo:hi], code[lo:hi] - at] = 1
        total += (there[left] @ there[right].T).astype(np.int64)
    return total


def forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links left[i] - right[i] between positions of ids: one edge from each linked id to the smallest of its component."""
    label = ids.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        if (label == before).all():
            break
    touched = np.unique(np.concatenate([left, right]))
    touched = touched[label[touched] != ids[touched]]
    return ids[touched], label[touched]


def _verify(k: int, percent: int):
    """Links between the documents of block i and those of block j of one group, as a spanning forest."""
    def run(group: pa.Table) -> pa.Table:
        data, offsets = S.string_buffers(group.column("t"))
        row, value = S.distinct(*_shingles(data, offsets, k)[::-1])
        n = len(group)
        ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
        size = np.bincount(row, minlength=n)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if len(right) == 1:
            inter = np.bincount(row[np.isin(value, value[row == right[0]])], minlength=n)[left][:, None]
        else:
            inter = common_counts(row, value, n, left, right)
        union = size[left][:, None] + size[right][None, :] - inter
        a, b = np.nonzero((100 * inter >= percent * union) & (inter > 0))
        a, b = left[a], right[b]
        a, b = a[a != b], b[a != b]
        x, y = forest(ids, a, b)
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def links(texts: DataFrame, member: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges a, b that join what the similar pairs of each cluster join.

    texts: component, node, bytes, t, checkpointed; member: node, bucket. A cluster is dealt into blocks, and each pair of blocks is compared in a task of its own. In clusters of more than LARGE
    documents that would be dear, so there all documents are first compared with the cluster's lead, one row a document, and of the others only
    the pairs that still matter are compared (see open_groups).
    """
    parts, none = tasks(texts.sparkSession), F.lit(0).cast("bigint")
    verify = lambda rows: rows.select("component", "part", F.col("node").alias("id"), "t", "block", "i", "j").repartition(parts, "component", "part", "i", "j").groupBy("component", "part", "i", "j").applyInArrow(_verify(k, percent), "a bigint, b bigint")

    def within(groups: DataFrame) -> DataFrame:
        placed = deal(groups, BLOCK, "bytes", BLOCK_BYTES)
        reach = F.when(F.col("rest") == 1, F.col("blocks")).otherwise(F.col("own"))
        pairs = placed.select("component", "part", "node", "t", "block", F.explode(F.sequence(none, reach - 1)).alias("other"))
        return verify(pairs.select("component", "part", "node", "t", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))

    all_of = lambda rows: rows.select("component", none.alias("part"), "node", F.lit(1).alias("rest"), "bytes", "t")
    large = texts.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("sum")).where(F.col("n") > LARGE)
    large = cut(large.select("component", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("sum") / BLOCK_BYTES)).alias("blocks")))
    if large.isEmpty():
        return within(all_of(texts))
    dealt = texts.join(apart(large, "component"), "component").withColumn("own", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")))
    lead, far = F.col("node") == F.col("component"), F.lit(-1).cast("bigint")
    star = dealt.select("component", none.alias("part"), "node", "t", F.when(lead, far).otherwise(F.col("own")).alias("block"), F.explode(F.when(lead, F.sequence(none, F.col("blocks") - 1)).otherwise(F.array("own"))).alias("i"), far.alias("j"))
    first = cut(verify(star))
    nodes = cut(dealt.select("node", "component").distinct())
    rest = nodes.where(~lead).join(first.select(F.col("a").alias("node")), "node", "left_anti").select("node")
    todo = open_groups(nodes, rest, member, LARGE)
    groups = all_of(texts.join(large, "component", "left_anti")).unionByName(todo.join(texts.select("node", "bytes", "t"), "node").select("component", "part", "node", "rest", "bytes", "t"))
    return first.unionByName(within(groups))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of k-word shingles have a Jaccard similarity of percent / 100 or more.

    1. Every text gives its set of shingle hashes, a key of the whole set and a fast similarity sketch cut into bands.
    2. Documents with equal sets form a class; only its smallest id goes on, so exact copies cost one row whatever their number.
    3. Classes that share a bucket of a band are tied to the smallest id of the bucket; the components of these ties are the candidate
       clusters. No pair is written: a bucket gives one row a member.
    4. Similarities are computed exactly from the full sets. A cluster is dealt into blocks of at most about BLOCK documents and BLOCK_BYTES bytes; a task holds two blocks and returns a
       spanning forest of the links between them. In a cluster of more than LARGE documents every document is first compared with the cluster's lead, and only those that
       aren't similar to it go on: they are compared with all others of the cluster, or of their buckets where that is less work. So a giant cluster of true copies costs
       one comparison a document, and a giant chain of different texts that boilerplate ties costs the squares of its buckets and not of the chain.
    5. The components of these links, by distributed contraction.

    Shingles are compared by 64-bit hashes (polynomials of words, modulo 2**64, finalised; two different shingles of a pair of texts of n shingles collide with a chance of about n**2 / 2**64 unless
    they were made to), and sets are taken as equal on two 64-bit sums. A pair at the threshold is missed by step 3 with a chance of MISS at most, unless other links join it anyway.
    Returns id, n_shingles, component_id (smallest id reachable), kept (id = component_id), one row per row of docs. Texts that are null or without words
    have an empty set and are linked with nothing. Rows without id take no part: component_id is null and kept true. Repeated rows get the
    same result each; other columns of docs are ignored.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    bands = band_count(percent)
    sets = cut(small_batches(base).mapInArrow(_sketch(k, bands), "id bigint, n bigint, k0 bigint, k1 bigint, bytes bigint, buckets array<bigint>"))
    classes = sets.where("n > 0 and id is not null").groupBy("k0", "k1").agg(F.min("id").alias("lead"))
    leaders = sets.select("k0", "k1", "id", "bytes", "buckets").join(classes.withColumnRenamed("lead", "id"), ["k0", "k1", "id"])
    member = leaders.select("id", F.explode("buckets").alias("bucket"))
    meeting = member.groupBy("bucket").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("top > b").select("bucket", "b")
    ties = member.join(apart(meeting, "bucket"), "bucket").select(F.col("id").alias("a"), "b").where("a <> b")
    clusters = cut(components(ties))
    narrow = leaders.select("id", "bytes").join(clusters.select(F.col("node").alias("id"), "component"), "id").dropDuplicates(["id"])
    texts = base.where("id is not null and t is not null").withColumn("digest", F.xxhash64("t"))
    with_text = cut(narrow.join(texts, "id").dropDuplicates(["id", "digest"]).select("component", F.col("id").alias("node"), "bytes", "t"))
    linked = components(links(with_text, member.select(F.col("id").alias("node"), "bucket"), k, percent))
    labels = classes.join(linked.select(F.col("node").alias("lead"), "component"), "lead", "left").select("k0", "k1", F.coalesce("component", "lead").alias("component"))
    out = sets.select("id", "n", "k0", "k1").join(apart(labels, "k0", "k1"), ["k0", "k1"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the smallest id, all columns as they were. Rows that share an id stay or go together; rows without id stay, and so do null and empty texts."""
    name = unused(docs)
    gone = near_dedup(docs, id_col, text_col, k, percent).where("not kept").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles of whole texts, linked at 100 * intersection >= 85 * union."""
    return near_dedup(table(spark, sf_dir, "documents"), percent=85).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def reference_components(rows: list[tuple[int, str | None]], k: int, percent: int) -> "pandas.DataFrame":  # noqa: F821
    """The same by brute force over all pairs, on the word tuples themselves; for tests on small tables."""
    import pandas as pd

    def shingles(text: str | None) -> frozenset:
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def find(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return pd.DataFrame([(i, len(s), find(i), find(i) == i) for i, s in sets], columns=["doc_id", "n_shingles", "component_id", "kept"])
