"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketching as S
from .common import crc_mod, cut, small_batches, table

#: Most labelled rows that the model is fitted on, chosen by a hash of their id; most lexicon terms; score from which a document is rejected.
SAMPLE, TERMS, REJECT = 12_000, 400, 0.7
#: Least labelled toxic documents that a learned term occurs in.
LEAST = 4

# Common insults, and second-person words, of four languages.
INSULTS = "arsehole asshole bastard bitch clown crap creep cretin disgusting dumb dumbass fool freak garbage idiot idiotic imbecile loser lunatic moron pathetic pig retard scum scumbag shit slut stupid trash twat ugly vermin whore worthless abschaum arschloch blödmann depp dreckskerl dummkopf hurensohn miststück trottel vollidiot wichser abruti connard conne crétin débile enculé ordure pourriture raclure salaud salope cabrón escoria gilipollas idiota imbécil inútil miserable pendejo puta tonto".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú usted ustedes vosotros vuestro".split()
# Signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

WORD = re.compile(r"[^\W\d_]+")
SECOND = re.compile(r"\b(?:" + "|".join(SECOND_PERSON) + r")\b")
STEMS = range(4, 9)
TIERS = (3.5, 2.0)
NEAR = 60
FEATURES = ["high_rate", "mid_rate", "low_rate", "high", "mid", "low", "kinds", "strongest", "near_you", "disguised", "capitals", "exclaim", "punctuation", "obfuscation", "digits", "words"]

_CAPITAL, _LETTER, _EXCLAIM, _PUNCTUATION, _SIGN, _DIGIT = (np.zeros(256, bool) for _ in range(6))
_CAPITAL[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_EXCLAIM[[33, 63]] = True
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT[48:58] = True
_SIGN[[*range(48, 58), 33, 36, 42, 46, 45, 64]] = True


class Lexicon:
    """Terms with weights, found at the starts of words by one automaton. A term that ends in "|" is a whole word, else a stem."""

    def __init__(self, terms: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        best: dict[str, dict[bool, float]] = {}
        for term, weight in terms.items():
            whole = term.endswith("|")
            own = best.setdefault(term.rstrip("|"), {})
            own[whole] = max(weight, own.get(whole, weight))
        for k, (stem, own) in enumerate(sorted(best.items())):
            self.automaton.add_word(stem, (k, len(stem), own.get(False, 0.0), own.get(True, 0.0)))
        if best:
            self.automaton.make_automaton()
        self.empty = not best

    def hits(self, low: str) -> dict[int, tuple[float, int]]:
        """By place: weight and number of the strongest term that starts there."""
        found: dict[int, tuple[float, int]] = {}
        if self.empty:
            return found
        for end, (k, n, stem, whole) in self.automaton.iter(low):
            start = end - n + 1
            if start and low[start - 1].isalnum():
                continue
            weight = max(stem, whole) if end + 1 == len(low) or not low[end + 1].isalnum() else stem
            if weight > found.get(start, (0.0, 0))[0]:
                found[start] = (weight, k)
        return found


def features(part: pa.RecordBatch, column: str, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text; whole texts, null as empty."""
    data, offsets = S.string_buffers(part.column(column))
    n = len(part)
    inside = np.ones(len(data), bool)
    inside[offsets[:-1][offsets[:-1] < len(data)]] = False
    inside[offsets[1:][offsets[1:] > 0] - 1] = False
    letter = _LETTER[data]
    disguise = _SIGN[data] & inside
    if len(data) > 2:
        disguise[1:-1] &= letter[:-2] & letter[2:] & ~(_DIGIT[data[:-2]] | _DIGIT[data[2:]])

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    letters, capitals, exclaim, punctuation, digits, signs = (count(f) for f in (letter, _CAPITAL[data], _EXCLAIM[data], _PUNCTUATION[data], _DIGIT[data], disguise))
    size = np.maximum(1.0, np.diff(offsets))
    out = np.zeros((n, len(FEATURES)))
    for r, text in enumerate(part.column(column).to_pylist()):
        if not text:
            continue
        low = text.lower()
        words = len(low.split()) or 1
        found = lexicon.hits(low)
        hidden = 0
        if signs[r]:
            plain = low.translate(LEET)
            hidden = max(0, len(lexicon.hits(plain)) - len(found))
        if found or hidden:
            weights = np.array([w for w, _ in found.values()] or [0.0])
            high, mid = int((weights >= TIERS[0]).sum()), int(((weights >= TIERS[1]) & (weights < TIERS[0])).sum())
            little = int((weights > 0).sum()) - high - mid
            near = sum(1 for at in found if SECOND.search(low, max(0, at - NEAR), at + NEAR))
            out[r, :10] = 100 * high / words, 100 * mid / words, 100 * little / words, np.log1p(high), np.log1p(mid), np.log1p(little), np.log1p(len({k for _, k in found.values()})), weights.max(), 100 * near / words, np.log1p(hidden)
        out[r, 15] = np.log1p(words)
    out[:, 10] = capitals / np.maximum(1, letters)
    out[:, 11], out[:, 12], out[:, 13], out[:, 14] = exclaim / size, punctuation / size, signs / size, digits / size
    return out


class Trees:
    """Boosted trees of equal depth on quantile bins, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0):
        n, d = x.shape
        self.depth, self.rate = depth, rate
        edges = [np.unique(np.concatenate([np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1]), np.quantile(pos, np.linspace(0, 1, 9)) if len(pos := x[x[:, j] > x[:, j].min(), j]) else []])) for j in range(d)]
        width = max(len(e) for e in edges) + 1
        code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        self.splits, self.leaves = [], []
        least = max(2, n // 400)
        score = np.full(n, self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            levels = []
            for level in range(depth):
                k = 1 << level
                size = k * width
                hist = np.stack([[np.bincount(node * width + code[:, j], w, size).reshape(k, width) for w in (g, h, None)] for j in range(d)])
                left = hist.cumsum(axis=3)[..., :-1]
                whole = hist.sum(axis=3, keepdims=True)
                right = whole - left
                gain = left[:, 0] ** 2 / (left[:, 1] + ridge) + right[:, 0] ** 2 / (right[:, 1] + ridge) - whole[:, 0] ** 2 / (whole[:, 1] + ridge)
                gain[(left[:, 2] < least) | (right[:, 2] < least)] = 0
                flat = gain.transpose(1, 0, 2).reshape(k, -1)
                best = flat.argmax(axis=1)
                feature, at = best // (width - 1), best % (width - 1)
                at = np.where(flat.max(axis=1) > 1e-9, at, width)
                limit = np.array([edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(feature, at, strict=True)])
                levels.append((feature, limit))
                node = 2 * node + (code[np.arange(n), feature[node]] > at[node])
            leaf = np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
            self.splits.append(levels)
            self.leaves.append(leaf * rate)
            score += leaf[node] * rate

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for levels, leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for feature, limit in levels:
                node = 2 * node + (x[rows, feature[node]] > limit[node])
            out += leaf[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit as points to interpolate between: mean x and mean y of each block."""
    blocks: list[list[float]] = []
    for a, b in zip(*(v[np.argsort(x, kind="stable")] for v in (x, y)), strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """A fitted scorer; small, and sent to the workers as it is."""

    def __init__(self, terms: dict[str, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.terms = terms
        self.constant = None
        if len(y) < 4 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        outside = np.zeros(len(y))
        for f in np.unique(fold):
            rest = fold != f
            outside[~rest] = Trees(x[rest], y[rest]).margin(x[~rest]) if len(set(y[rest])) == 2 else 0.0
        self.trees = Trees(x, y)
        self.curve = isotonic(outside, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        margin = self.trees.margin(x)
        return np.clip(0.99 * np.interp(margin, *self.curve) + 0.01 / (1 + np.exp(-margin)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents (parameter of the fit; the texts are read whole).

    usable: a condition on the labels' columns for rows that may be learned from. One half of the sample teaches the lexicon: stems and whole words that occur in toxic
    documents much oftener, counted on the workers; a listed insult that they show to be harmless is dropped. The other half trains the trees; predictions of trees fitted without a row's third of it calibrate
    them by isotonic regression. Null labels or ids are ignored; of repeated labels the largest holds; without labelled rows every score is 0, and with one class its label.
    """
    chosen = labels.where(usable) if usable is not None else labels
    chosen = chosen.select(F.col(label_id).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "id")
    texts = cut(texts.withColumn("part", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(6)).cast("int")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("t").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                seen[label == 1].update({w[:k] for w in words for k in STEMS if len(w) >= k} | {w + "|" for w in words if 3 <= len(w) <= 32} | {""})
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    counted = cut(small_batches(texts).where("part < 3").mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("term") == "") | (F.col("toxic") >= LEAST) | F.col("term").isin([f"{w}|" for w in INSULTS])))
    whole = counted.where("term = ''").first()
    terms = {w + "|": TIERS[0] + 1 for w in INSULTS}
    if whole is not None:
        odds = F.log((F.col("toxic") + 0.5) / (whole.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (whole.clean + 1.0))
        doubt = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))  # standard error: a term seen in few documents weighs less
        harmless = counted.where(F.col("term").isin(list(terms)) & (odds + 1.5 * doubt < 1.0))  # listed words that the labels show in clean texts just as often
        for r in harmless.select("term").collect():
            del terms[r.term]
        ranked = counted.where(F.col("term") != "").where(F.col("toxic") >= LEAST).withColumn("weight", odds - 1.5 * doubt).where("weight >= 1.0").orderBy((F.col("weight") * F.sqrt("toxic")).desc(), "term").limit(TERMS)
        terms |= {r.term: max(r.weight, terms.get(r.term, 0.0)) for r in ranked.collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            for part in S.slices(batch, "t"):
                x = features(part, "t", lexicon)
                yield pa.RecordBatch.from_arrays([part.column("part"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["part", "label", "x"])

    rows = texts.where("part >= 3").mapInArrow(measure, "part int, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.x, r.label))
    return Model(terms, np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([float(r.label == 1) for r in rows]), np.array([r.part for r in rows]))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic) of every whole text, without a shuffle. A null text is scored as empty; ids may be null or repeated;
    other columns are ignored; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for batch in batches:
            for part in S.slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(features(part, "t", lexicon)))], names=["doc_id", "score"])

    return small_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """docs without the rows that score `reject` or more, all columns as they were."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for batch in batches:
            bare = pa.RecordBatch.from_arrays([batch.column(place).cast(pa.string()), pa.array(np.arange(len(batch)))], names=["t", "at"])
            keep = [model.score(features(part, "t", lexicon)) < reject for part in S.slices(bare, "t")]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return small_batches(docs).mapInArrow(run, docs.schema)


def learnable(column: str = "doc_id"):
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return crc_mod(column, 3) != 1


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of documents, one row each; learned from labels outside the held-out fold. Null and empty texts are scored too; a null id isn't held out; repeated rows get a row each."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels"), learnable()))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
