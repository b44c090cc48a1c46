"""Benchmark decontamination by greedy string tiling with Karp-Rabin hashes."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, unused

WORD = re.compile(r"[^\W_]+")
#: Shortest tile in words, share of an item's words that tiles must cover, and most words of a benchmark that is sent to every task.
MIN_MATCH, COVERAGE, BLOCK_WORDS = 5, 0.6, 2_000_000
#: Most seeds that are held at once, and most verdicts that are sent to every task.
SEEDS, BROADCAST = 1 << 20, 200_000
PRIME = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all k-word windows, modulo 2**64."""
    n = len(ids) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k if n > 0 else 0):
            out = out * PRIME + ids[j : j + n].astype(np.uint64)
    return out


def tile(item_words: int, text_words: int, p: np.ndarray, q: np.ndarray, length: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: tiles (place in item, place in text, length), the longest first, none overlapping in either.

    p, q, length: the maximal matches. The longest match is marked first (ties: leftmost in the item, then in the text); of a match that meets marked words the free stretches of
    k words or more go back into the heap.
    """
    heap = list(zip((-length).tolist(), p.tolist(), q.tolist(), strict=True))
    heapq.heapify(heap)
    free_item, free_text = np.ones(item_words, bool), np.ones(text_words, bool)
    tiles, open_words = [], item_words
    while heap and open_words >= k:
        minus, a, b = heapq.heappop(heap)
        n = -minus
        free = free_item[a : a + n] & free_text[b : b + n]
        if free.all():
            free_item[a : a + n] = free_text[b : b + n] = False
            tiles.append((a, b, n))
            open_words -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo >= k:
                heapq.heappush(heap, (lo - hi, a + lo, b + lo))
    return tiles


def runs(owner: np.ndarray, p: np.ndarray, q: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches (item, place in it, place in the text, number of windows) with those put together that follow each other on one diagonal."""
    order = np.lexsort((p, q - p, owner))
    owner, p, q, length = owner[order], p[order], q[order], length[order]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(q - p) != 0) | (p[1:] != p[:-1] + length[:-1])
    first = np.flatnonzero(new)
    return owner[first], p[first], q[first], np.add.reduceat(length, first) if len(first) else length


class Items:
    """Benchmark items: vocabulary, words and window hashes. With `short`, items of fewer than k words are found as a whole."""

    def __init__(self, rows: list[tuple[int | None, str]], k: int, short: bool = False):
        self.k = k
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words, hashes, owner, place = [], [], [], [], []
        self.short: dict[int, dict[tuple[int, ...], list[int | None]]] = {}
        for item_id, text in rows:
            w = words_of(text)
            if len(w) < k and not (short and w):
                continue
            coded = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int32)
            if len(w) < k:
                self.short.setdefault(len(w), {}).setdefault(tuple(coded.tolist()), []).append(item_id)
                continue
            h = windows(coded, k)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids)))
            place.append(np.arange(len(h)))
            self.ids.append(item_id)
            self.words.append(coded)
        self.base = np.cumsum([0, *map(len, self.words)])
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int32)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)

    def matches(self, coded: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, place in item, place in text, number of windows) of all maximal matches. Equal windows are the seeds, compared word by word; they are made for a bounded number of
        places at a time and put together at once, so that a text of one repeated word costs time but no memory."""
        k, h = self.k, windows(coded, self.k)
        whole = np.ones(len(h), bool)
        for j in range(k):
            whole &= coded[j : j + len(h)] > 0
        q = np.flatnonzero(whole)
        lo, hi = np.searchsorted(self.hash, h[q], "left"), np.searchsorted(self.hash, h[q], "right")
        q, lo, count = q[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        found = tuple(np.zeros(0, np.int64) for _ in range(4))
        ends = np.cumsum(count)
        start = 0
        while start < len(q):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SEEDS, "right")))
            n = count[start:stop]
            at = np.repeat(lo[start:stop] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            own, p, qq = self.owner[at], self.place[at], np.repeat(q[start:stop], n)
            same = np.ones(len(own), bool)
            for j in range(k):
                same &= self.flat[self.base[own] + p + j] == coded[qq + j]
            new = own[same], p[same], qq[same], np.ones(int(same.sum()), np.int64)
            found = runs(*map(np.concatenate, zip(found, runs(*new), strict=True)))
            start = stop
        return found

    def judge(self, text: str | None, coverage: float) -> tuple[int, float, int | None, list[tuple[int, int, int]]]:
        """Number of items covered to `coverage` or more, the largest coverage, that item's id (the smallest of a tie), and its tiles."""
        w = words_of(text)
        get = self.vocabulary.get
        coded = np.array([get(x, 0) for x in w], np.int32)
        n, best, best_id, best_tiles = 0, 0.0, None, []
        if len(coded) >= self.k and len(self.hash):
            owner, p, q, length = self.matches(coded)
            for item in np.unique(owner).tolist():
                mine = owner == item
                tiles = tile(len(self.words[item]), len(coded), p[mine], q[mine], length[mine] + self.k - 1, self.k)
                share = sum(t[2] for t in tiles) / len(self.words[item])
                n += share >= coverage
                if better(share, self.ids[item], best, best_id):
                    best, best_id, best_tiles = share, self.ids[item], tiles
        for size, known in self.short.items():
            listed = coded.tolist()
            first: dict[tuple[int, ...], int] = {}
            for at in range(len(listed) - size + 1):
                key = tuple(listed[at : at + size])
                if key in known:
                    first.setdefault(key, at)
            for key, at in first.items():
                n += len(known[key])
                for item_id in known[key]:
                    if better(1.0, item_id, best, best_id):
                        best, best_id, best_tiles = 1.0, item_id, [(0, at, size)]
        return n, best, best_id, best_tiles


def better(share: float, item_id: int | None, best: float, best_id: int | None) -> bool:
    """Whether an item is the one to report: the larger share, then the smaller id, null ids last."""
    return share > best or (share == best > 0 and item_id is not None and (best_id is None or item_id < best_id))


_JUDGED = "n bigint, best double, item bigint, tiles array<array<int>>"


def _fields(judged: list) -> list[pa.Array]:
    n, best, item, tiles = zip(*judged, strict=True) if judged else ((), (), (), ())
    return [pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(item, pa.int64()), pa.array([[list(x) for x in t] for t in tiles], pa.list_(pa.list_(pa.int32())))]


def small_benchmark(items: DataFrame, most_words: int) -> list[tuple[int | None, str]] | None:
    """The items (i, t), or None if they have more than most_words words (a word counts two bytes at least, so the bytes tell without reading them here)."""
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > 2 * most_words:
        return None
    return [(r.i, r.t) for r in items.orderBy("i", "t").collect()]


def joined_verdicts(docs: DataFrame, items: DataFrame, k: int, coverage: float, short: bool) -> DataFrame:
    """digest, n, best, item, tiles for every different text of docs (digest, t) that shares a seed with an item, by a join on the seeds; it holds no more of the benchmark in one place than one item.

    Documents and items give the hashes of their windows (of k words, or of a short item's own length), which are joined; of the pairs that meet, each is tiled in a row of its own.
    """
    import xxhash

    lengths = [k]
    if short:
        count = F.udf(lambda t: len(words_of(t)), "int")
        lengths += sorted(r.n for r in items.select(count("t").alias("n")).where(f"n > 0 and n < {k}").distinct().collect())

    def windows_of(key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    coded = np.array([xxhash.xxh3_64_intdigest(w) for w in words_of(text)], np.uint64)
                    sizes = lengths if key == "digest" else [k if len(coded) >= k else len(coded)]
                    for size in (n for n in sizes if n in lengths):
                        h = np.unique(windows(coded, size)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(h), pa.binary()), pa.array(np.full(len(h), size, np.int32)), pa.array(h)], names=[key, "size", "hash"])

        return run

    own = items.groupBy(F.unhex(F.sha2("t", 256)).alias("of")).agg(F.min("i").alias("i"), F.count("*").alias("copies"), F.first("t").alias("item"))
    seeds = own.select("of", "item").mapInArrow(windows_of("of"), "of binary, size int, hash bigint")
    texts = docs.dropDuplicates(["digest"])
    met = texts.mapInArrow(windows_of("digest"), "digest binary, size int, hash bigint").join(seeds, ["size", "hash"]).select("digest", "of").distinct()
    pairs = met.join(own, "of").join(texts, "digest").select("digest", "t", "i", "copies", "item")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, item_id, copies, item in zip(*(batch.column(c).to_pylist() for c in ("t", "i", "copies", "item")), strict=True):
                n, *rest = Items([(item_id, item)], k, short).judge(text, coverage)
                out.append((n * copies, *rest))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *_fields(out)], names=["digest", "n", "best", "item", "tiles"])

    judged = pairs.mapInArrow(judge, f"digest binary, {_JUDGED}")
    top = F.min_by(F.struct("best", "item", "tiles"), F.struct(-F.col("best"), F.col("item").isNull(), "item"))
    return judged.groupBy("digest").agg(F.sum("n").alias("n"), top.alias("top")).select("digest", "n", "top.*")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, short_items: bool = False,
) -> DataFrame:
    """How much of a benchmark item each whole document holds, in any order of its passages.

    Windows of min_match words that a document shares with an item seed maximal matches, which are tiled greedily. A benchmark of block_words words at most is sent to every task, and documents are
    judged in one pass without a shuffle; a larger one is joined with the documents on the hashes of the windows (see joined_verdicts). Both ways give the same rows.
    Words are runs of letters and digits, lower-cased. An item of fewer than min_match words can't be tiled; with short_items a document that holds it as a whole is covered, else it contaminates nothing.

    Returns doc_id, n_items (items covered to `coverage` or more), coverage (largest share of an item's words under tiles), item_id (that item; smallest id of a tie, null ids last;
    null if nothing matches), tiles (place in item, place in document, length, in words, of that item), contaminated. One row per row of docs; a null or
    empty text is clean; ids may be null or repeated; other columns are ignored; null items are ignored; without items all documents are clean.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    bare = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = small_benchmark(items, block_words)
    if rows is not None:
        sent, made = docs.sparkSession.sparkContext.broadcast(rows), []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(Items(sent.value, min_match, short_items))
            for batch in batches:
                judged = [made[0].judge(text, coverage) for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *_fields(judged)], names=["id", "n", "best", "item", "tiles"])

        out = small_batches(bare).mapInArrow(run, f"id bigint, {_JUDGED}")
    else:
        keyed = bare.withColumn("digest", F.unhex(F.sha2("t", 256)))
        verdicts = cut(joined_verdicts(keyed.where("t is not null").select("digest", "t"), items, min_match, coverage, short_items))
        verdicts = F.broadcast(verdicts) if verdicts.count() <= BROADCAST else verdicts
        out = keyed.select("id", "digest").join(verdicts, "digest", "left").select("id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("best", F.lit(0.0)).alias("best"), "item", F.coalesce("tiles", F.array().cast("array<array<int>>")).alias("tiles"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_items"), F.col("best").alias("coverage"), F.col("item").alias("item_id"), "tiles", (F.col("n") > 0).alias("contaminated"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, short_items: bool = False,
) -> DataFrame:
    """docs without the rows that hold a benchmark item, all columns as they were; the rules are those of contamination(). Null and empty texts stay."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    rows = small_benchmark(items, block_words)
    if rows is None:
        name = unused(docs)
        digest = F.unhex(F.sha2(F.col(f"`{text_col}`").cast("string"), 256))
        found = joined_verdicts(docs.select(digest.alias("digest"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null"), items, min_match, coverage, short_items)
        gone = cut(found.where("n > 0").select(F.col("digest").alias(name)))
        return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST else gone, digest == F.col(name), "left_anti")
    place, sent, made = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(rows), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Items(sent.value, min_match, short_items))
        for batch in batches:
            yield batch.filter(pa.array([not made[0].judge(text, coverage)[0] for text in batch.column(place).to_pylist()], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of documents against all items of benchmark, those of fewer than five words too, as wholes. One row per document; null and empty texts are clean."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)
