"""URL filters: rules first, then the ratio of two smoothed variable-order Markov models of characters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Symbols of the models. 0 stands for either end of a URL, the last for any other character; all digits are one symbol.
SIGNS = "./-_?=&#%:~+@"
ALPHABET = 1 + len(LOWER) + 1 + len(SIGNS) + 1
#: Characters of a gram: the symbol and a context of up to three before it.
ORDER = 4
GRAMS = ALPHABET**ORDER
#: One in so many ruled URLs is kept from the counts, to set the threshold. Width and number of the bins of its histogram.
HELD, BIN, BINS = 5, 0.01, 2000

_CODE = np.full(256, ALPHABET - 1, np.int64)
_CODE[[*range(97, 123)]] = np.arange(1, 27)
_CODE[[*range(65, 91)]] = np.arange(1, 27)
_CODE[[*range(48, 58)]] = 27
_CODE[[ord(c) for c in SIGNS]] = np.arange(28, 28 + len(SIGNS))


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all its subdomains, where the path starts with its path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The production rules.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tail_of(url: Column) -> Column:
    """What follows host and path: the query and the fragment, with their signs."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The name of the longest rule that fits, else null; of equally long ones the first by name."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    tests = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name)) for r in ranked]
    return F.coalesce(*tests, F.lit(None).cast("string"))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character of each text and at its end, and the row of each."""
    from .sketching import string_buffers

    data, offsets = string_buffers(column)
    n, pad = len(offsets) - 1, ORDER - 1
    size = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n) * (pad + 1)
    codes = np.zeros(len(data) + n * (pad + 1), np.int64)
    row = np.repeat(np.arange(n), size)
    codes[np.arange(len(data)) - offsets[:-1][row] + starts[row] + pad] = _CODE[data]
    whole = np.zeros(max(0, len(codes) - pad), np.int64)
    for j in range(ORDER):
        whole = whole * ALPHABET + codes[j : j + len(whole)]
    owner = np.repeat(np.arange(n), size + pad + 1)[: len(whole)]
    place = np.arange(len(whole)) - starts[owner]
    inside = place <= size[owner]
    return whole[inside], owner[inside]


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(last symbol | up to three before it) for every gram, by Witten-Bell smoothing: a context that was seen mixes its own counts with the next
    shorter context's distribution, by the number of its different successors; one that was not seen leaves it to the shorter one."""
    below = np.full((1, ALPHABET), 1 / ALPHABET)
    for k in range(1, ORDER + 1):
        own = counts.reshape(ALPHABET ** (ORDER - k), -1, ALPHABET).sum(axis=0)
        total, kinds = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
        lower = np.tile(below, (len(own) // len(below), 1))
        below = np.where(total > 0, (own + kinds * lower) / np.maximum(1, total + kinds), lower)
    return np.log(below).ravel()


def _with_rule(pages: DataFrame, id_col: str, url_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    bare = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    split = bare.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tail_of(F.col("url")).alias("tail"))
    ruled = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = {r.name: r.verdict for r in rules}
    by_rule = F.create_map(*[F.lit(x) for pair in verdict.items() for x in pair])[F.col("rule")] if rules else F.lit(None).cast("string")
    return ruled.withColumn("by_rule", by_rule).withColumn("u", F.concat("host", "path", "tail")).drop("tail")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict on every url: the longest fitting rule's, else that of the models.

    Two models of characters are counted over all urls that a rule allows or blocks (host, path, query and fragment; every fifth, by a hash of them, is left out; rules see host and path only). The counts are summed per
    partition and then over the cluster; there are ALPHABET**ORDER grams at most, whatever the number of urls, so the tables that are sent to the driver and
    to the workers are bounded (a float for each gram). The score of a url is the mean over its characters of log P(allowed) - log P(blocked). The urls left out give, as a histogram of all their
    scores, the threshold with the least mean error of the two classes; without such urls of both classes it is 0. Urls that score the threshold or more are allowed.

    Returns id, host, path, rule, verdict, score. A null url or one without `://` has empty host and path and is judged as an empty url. Ids may be null or repeated; other columns are
    ignored; an empty table gives an empty one; without rules all scores are 0.
    """
    spark = pages.sparkSession
    ruled = _with_rule(pages, id_col, url_col, rules)
    held = F.pmod(F.xxhash64("u"), F.lit(HELD)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            allowed = np.array(batch.column("allow").to_pylist(), bool)
            gram, row = grams(batch.column("u"))
            total = np.zeros(2 * GRAMS, np.int64) if total is None else total
            total += np.bincount(gram + GRAMS * allowed[row], minlength=2 * GRAMS)
        if total is not None:
            seen = np.flatnonzero(total)
            for at in range(0, len(seen), 1 << 16):
                part = seen[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["gram", "n"])

    taught = ruled.where(F.col("by_rule").isNotNull())
    counted = taught.where(~held).select("u", (F.col("by_rule") == "allow").alias("allow")).mapInArrow(count, "gram bigint, n bigint")
    got = counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * GRAMS, np.int64)
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    both = counts[:GRAMS].any() and counts[GRAMS:].any()
    ratio = (log_model(counts[GRAMS:]) - log_model(counts[:GRAMS])).astype(np.float32) if both else np.zeros(GRAMS, np.float32)
    sent = spark.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, row = grams(batch.column("u"))
            n = len(batch)
            total = np.bincount(row, sent.value[gram].astype(float), minlength=n) / np.maximum(1, np.bincount(row, minlength=n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*batch.schema.names, "score"])

    schema = "id bigint, host string, path string, rule string, by_rule string, u string, score double"
    ruled = ruled.withColumn("id", F.col("id").cast("bigint"))
    bin_of = F.greatest(F.lit(-BINS // 2), F.least(F.lit(BINS // 2), F.floor(F.col("score") / BIN)))
    rows = ruled.where(F.col("by_rule").isNotNull() & held).mapInArrow(score, schema).groupBy(bin_of.alias("bin")).agg(F.count(F.when(F.col("by_rule") == "allow", 1)).alias("good"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("bad")).orderBy("bin").collect()
    good, bad = sum(r.good for r in rows), sum(r.bad for r in rows)
    threshold = 0.0
    if good and bad:
        below_good = below_bad = 0
        low, cuts = -BINS * BIN, []
        for r in rows:  # between two occupied bins any threshold errs alike; the one next to 0 is taken
            cuts.append(((below_good / good + (bad - below_bad) / bad) / 2, min(max(0.0, low), r.bin * BIN)))
            below_good, below_bad, low = below_good + r.good, below_bad + r.bad, (r.bin + 1) * BIN
        cuts.append((0.5, max(0.0, low)))
        threshold = min(cuts, key=lambda c: (c[0], abs(c[1])))[1]
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return ruled.mapInArrow(score, schema).select("id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All urls of pages, one row each, by the production rules and models. A null url or one without `://` has empty host and path and a verdict of the models; repeated rows get a row each."""
    return judge_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
