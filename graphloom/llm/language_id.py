"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketching as S
from .common import crc_mod, small_batches, table

#: Most training documents of a language and of all languages (expected numbers), buckets of n-grams, longest n-gram in bytes, and margin below which a prediction is ambiguous.
PER_LANGUAGE, TRAINING, BUCKETS, LONGEST, MARGIN = 1_500, 24_000, 2048, 3, 0.1
#: Up to so many languages every split is a bit of the code; beyond, BITS random ones are drawn.
EXHAUSTIVE, BITS = 6, 47
UNKNOWN = "und"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not 97 <= c <= 122]] = 32


def vectors(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of 1 to LONGEST bytes of the lower-cased texts; ASCII signs and digits count as spaces."""
    data, offsets = S.string_buffers(pc.utf8_lower(texts))
    data = _PLAIN[data].astype(np.uint64)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    total = np.zeros(n * BUCKETS)
    with np.errstate(over="ignore"):
        code = np.zeros(len(data), np.uint64)
        for k in range(LONGEST):
            m = max(0, len(data) - k)
            code = (code[:m] << S.U(8)) | data[k : k + m]
            same = row[:m] == row[k : k + m]
            bucket = (S.mix(code + S.BASE * S.U(k + 1)) >> S.U(40)).astype(np.int64) % BUCKETS
            total += np.bincount((row[:m] * BUCKETS + bucket)[same], minlength=n * BUCKETS)
    total = total.reshape(n, BUCKETS)
    return np.sqrt(total / np.maximum(1, total.sum(axis=1, keepdims=True))).astype(np.float32)


def code_words(count: int) -> np.ndarray:
    """A row of -1 and 1 for each language: all different splits for few languages, else the random code with the largest least distance of 64 draws."""
    if count <= EXHAUSTIVE:
        splits = [s for s in range(1, 1 << (count - 1))]
        return np.array([[1 if (s >> k) & 1 else -1 for s in splits] for k in range(count)]).reshape(count, len(splits))
    draw, best = np.random.default_rng(count), None
    for _ in range(64):
        code = draw.choice([-1, 1], size=(count, BITS))
        gap = min(int((code[a] != code[b]).sum()) for a in range(count) for b in range(a))
        if (best is None or gap > best[0]) and (np.abs(code.sum(axis=0)) < count).all():
            best = (gap, code)
    return best[1]


class Coder:
    """Linear classifiers of the bits, their weights, and the code."""

    def __init__(self, x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 150, ridge: float = 1e-5):
        self.languages = languages
        self.code = code_words(len(languages))
        bits = self.code.shape[1]
        self.w, self.b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
        self.trust = np.ones(bits)
        if not bits:
            return
        target = self.code[y].astype(np.float32)
        share = np.bincount(y, minlength=len(languages))
        weight = (1 / share[y])[:, None].astype(np.float32)
        weight /= weight.sum()
        w, b, last_w, last_b = self.w.copy(), self.b.copy(), self.w, self.b
        rate = 4.0
        for i in range(rounds):
            pull = i / (i + 3)
            at_w, at_b = w + pull * (w - last_w), b + pull * (b - last_b)
            slope = -target * weight / (1 + np.exp(target * (x @ at_w + at_b)))
            last_w, last_b = w, b
            w, b = at_w - rate * (x.T @ slope + ridge * at_w), at_b - rate * slope.sum(axis=0)
        self.w, self.b = w, b
        wrong = (weight * (target * (x @ w + b) <= 0)).sum(axis=0)
        self.trust = np.maximum(0.01, 1 - 2 * wrong)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest code word by the weighted logistic loss of all bits: share of each language, and the loss's gap to the second, a bit."""
        if len(self.languages) < 2:
            return np.ones((len(x), 1)), np.full(len(x), np.inf)
        margin = np.clip(x @ self.w + self.b, -30, 30)
        loss = np.stack([(np.log1p(np.exp(-margin * word)) * self.trust).sum(axis=1) for word in self.code], 1) / self.trust.sum()
        ranked = np.sort(loss, axis=1)
        share = np.exp(-4 * (loss - ranked[:, :1]))
        return share / share.sum(axis=1, keepdims=True), ranked[:, 1] - ranked[:, 0]


def fit(docs: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, training: int = TRAINING) -> Coder | None:
    """Classifiers from about `per_language` documents of each language at most, and `training` in all (parameters of the fit, which bound what comes to the driver: 8 KB a document; whole texts), drawn by a hash of the id at a rate that the count of the language
    sets, so rare languages are kept whole. usable: a condition on docs' columns for rows that may be learned from. Null languages, ids and texts are left out; None if nothing is left."""
    chosen = docs.where(usable) if usable is not None else docs
    chosen = chosen.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and t is not null and lang is not null")
    counts = {r.lang: r.n for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    unit = 1 << 30
    rate = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(unit, min(per_language, training // len(counts) + 1) * unit // n))])[F.col("lang")]
    drawn = chosen.where(F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(unit)) < rate).select("t", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                for part in S.slices(batch.slice(at, 128), "t"):
                    x = vectors(part.column("t"))
                    yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    got = small_batches(drawn).mapInArrow(run, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, BUCKETS)
    langs = got.column("lang").to_pylist()
    order = np.lexsort((x @ np.arange(BUCKETS, dtype=np.float32), langs))
    names = sorted(set(langs))
    if not names:
        return None
    return Coder(x[order], np.array([names.index(langs[i]) for i in order]), names)


def identify(docs: DataFrame, coder: Coder | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous, for every whole text, without a shuffle.

    `und` with score 0 if the text is null or has no letter, or nothing was learned. ambiguous: the second code word is nearly as close as the first. Ids may be null or repeated; other columns are
    ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                for part in S.slices(batch.slice(at, 128), "t"):
                    known = np.array([coder is not None and t is not None and any(map(str.isalpha, t)) for t in part.column("t").to_pylist()], bool)
                    pred, score, unsure = np.full(len(part), UNKNOWN, object), np.zeros(len(part)), ~known
                    if known.any():
                        share, gap = coder.decode(vectors(part.column("t")))
                        best = share.argmax(axis=1)
                        pred[known] = np.array(coder.languages, object)[best[known]]
                        score[known] = share.max(axis=1)[known]
                        unsure |= gap < MARGIN
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return small_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of documents, one row each; learned from rows outside the held-out fold. `und` with score 0 for a null text or one without a letter; a null id isn't held out; repeated rows get a row each."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, crc_mod("doc_id", 4) != 2))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
