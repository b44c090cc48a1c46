"""Toxicity, language and URL models: held-out quality, calibration, edge cases."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language_id, toxicity, url_filter
from graphloom.llm.queries import QUERIES

MID = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    got = QUERIES["op5_toxicity"](spark, MID).toPandas()
    labels = duckdb.sql(f"select doc_id, toxic from '{MID}/labels.parquet'").df()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert len(got) == 1000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    rank = held["score"].rank()
    y = held["toxic"] == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.85
    assert ((held["predicted"] == 1) & ~y).sum() <= 0.02 * (~y).sum()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you are an idiot", 1.0), (2, None, 1.0), (3, "", 1.0), (None, "fine words here", 1.0), (1, "fine words here", 1.0)], "doc_id bigint, text string, score double")
    no_labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, no_labels)
    assert {r.score for r in toxicity.toxicity(docs, model).collect()} == {0.0}
    rows = [(i, "you total idiot and moron number %d" % i if i % 2 else "a calm and pleasant walk number %d" % i) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(train, labels)
    got = [r.score for r in toxicity.toxicity(docs, model).collect()]
    assert len(got) == 5 and got[0] > 0.9 and max(got[1:]) < 0.3
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == 4
    assert toxicity.toxicity(docs.where("false"), model).count() == 0


def test_isotonic_is_monotone_and_calibrated():
    draw = np.random.default_rng(0)
    x = draw.normal(size=400)
    y = (draw.random(400) < 1 / (1 + np.exp(-2 * x))).astype(float)
    at, level = toxicity.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(level) > 0).all()
    assert abs(np.interp(x, at, level).mean() - y.mean()) < 0.02


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(1)
    x = draw.random((1500, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = toxicity.Trees(x[:1000], y[:1000])
    assert (((t.margin(x[1000:]) > 0) == y[1000:]).mean()) > 0.9


def test_disguised_words_are_seen():
    import pyarrow as pa

    batch = pa.record_batch({"t": ["what an i1d1ot", "what an 1d1ot", "plain", None]})
    x = toxicity.features(batch, "t", toxicity.Lexicon({"idiot|": 4.0}))
    assert x[1, toxicity.FEATURES.index("disguised")] > 0 and x[2].sum() < 1


def test_language_held_out(spark):
    got = QUERIES["op8_language_id"](spark, MID).toPandas()
    truth = duckdb.sql(f"select doc_id, lang from '{MID}/documents.parquet'").df()
    held = got.merge(truth, on="doc_id").query("held_out")
    assert len(got) == 1000 and (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 40)] + [(100, None, "en", "x"), (101, "12 34!", None, "x"), (None, "the dog", None, "x"), (102, "", None, "x")], "doc_id bigint, text string, lang string, lang_pred string")
    coder = language_id.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, coder).collect()}
    assert got[0][0] == "en" and got[1][0] == "de" and got[None][0] == "en"
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert language_id.fit(docs.where("false")) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), coder).count() == 0
    one = language_id.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify(docs.where("doc_id < 4"), one).collect()} == {"en"}


@pytest.mark.parametrize("count", [2, 4, 6, 9, 20])
def test_codes_keep_their_distance(count):
    code = language_id.code_words(count)
    gap = min(int((code[a] != code[b]).sum()) for a in range(count) for b in range(a))
    assert gap >= (2 ** (count - 2) if count <= language_id.EXHAUSTIVE else language_id.BITS // 5)


URLS = ["http://A.Example.NET/en/1?x=/fr/#z", "https://example.net/de/2", "ftp://x.net", "http://y.org/fr/3", "http://badexample.com/de/4", "http://www.example.com/de/5#a", "no scheme", None, "", "http://org/fr/", "a://b://c/d", "http://example.com?de/", "http://notnet/x"]


def brute_url(url):
    """Host, path and rule as their definition reads."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])])
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)).name if fits else None


def test_url_rules_and_edges(spark):
    pages = spark.createDataFrame([(i, u, "h", "s") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, score string")
    got = {r.id: r for r in url_filter.judge_urls(pages).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == {i: brute_url(u) for i, u in enumerate(URLS)}
    verdict = {r.name: r.verdict for r in url_filter.RULES}
    assert all(r.verdict == verdict[r.rule] for r in got.values() if r.rule) and {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge_urls(pages.where("false")).count() == 0
    assert {r.score for r in url_filter.judge_urls(pages, ()).collect()} == {0.0}


def test_url_rules_on_the_table(spark):
    pages = duckdb.sql(f"select page_id, url from '{MID}/pages.parquet'").fetchall()
    got = {r.page_id: (r.host, r.path, r.rule) for r in QUERIES["op3_url_filter"](spark, MID).collect()}
    assert got == {i: brute_url(u) for i, u in pages}


def test_models_are_distributions():
    draw = np.random.default_rng(0)
    counts = np.zeros(url_filter.GRAMS, np.int64)
    counts[draw.integers(0, url_filter.GRAMS, 5000)] += 1
    p = np.exp(url_filter.log_model(counts)).reshape(-1, url_filter.ALPHABET)
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()


def test_url_model_separates(spark):
    draw = np.random.default_rng(3)
    name = lambda letters: "".join(draw.choice(list(letters), 8))
    rows = [(i, f"http://{name('abcde')}.org/fr/{name('abcde')}") for i in range(300)] + [(1000 + i, f"http://{name('vwxyz')}.net/{name('vwxyz')}") for i in range(300)]
    fresh = [(5000, "http://vyxzwv.com/zyxwv"), (5001, "http://abcdea.com/edcba")]
    pages = spark.createDataFrame(rows + fresh, "page_id bigint, url string")
    got = {r.id: r.verdict for r in url_filter.judge_urls(pages).where(F.col("id") >= 5000).collect()}
    assert got == {5000: "block", 5001: "allow"}


def test_url_models_see_query_and_fragment(spark):
    """Urls of two kinds that differ only after their path get verdicts of their own."""
    draw = random.Random(6)
    number = lambda: draw.randrange(10**6)
    rows = [(i, f"http://{'www.example.net/en/' if i % 2 else 'www.site.net/'}?{'article=news' if i % 2 else 'casino=bonus'}&n={number()}#{'text' if i % 2 else 'win'}") for i in range(3000)]
    pairs = [(5000 + i, f"http://other.test/page?{'article=news' if i % 2 else 'casino=bonus'}&n={number()}#{'text' if i % 2 else 'win'}") for i in range(40)]
    got = {r.id: r for r in url_filter.judge_urls(spark.createDataFrame(rows + pairs, "page_id bigint, url string")).where(F.col("id") >= 5000).collect()}
    assert {r.path for r in got.values()} == {"/page"}
    assert [got[5000 + i].verdict for i in range(40)] == ["block", "allow"] * 20


def test_decoding_takes_the_nearest_code_word():
    """Loss-weighted decoding against loops over languages and bits."""
    draw = np.random.default_rng(4)
    x = draw.random((120, 30)).astype(np.float32)
    y = np.repeat(np.arange(4), 30)
    x[np.arange(120), y * 5] += 1
    coder = language_id.Coder(x, y, ["a", "b", "c", "d"], rounds=30)
    share, gap = coder.decode(x)
    for row in range(0, 120, 7):
        losses = []
        for word in coder.code:
            loss = 0.0
            for j, bit in enumerate(word):
                margin = float(np.clip(sum(float(x[row, i]) * float(coder.w[i, j]) for i in range(30)) + float(coder.b[j]), -30, 30))
                loss += float(coder.trust[j]) * np.log1p(np.exp(-margin * bit))
            losses.append(loss / coder.trust.sum())
        order = np.argsort(losses)
        assert share[row].argmax() == order[0] and abs(gap[row] - (losses[order[1]] - losses[order[0]])) < 1e-4
    assert (share.argmax(axis=1) == y).mean() > 0.95


def test_signs_and_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² ① Ⅻ 12!"), (2, "a"), (3, "é"), (4, "日")], "doc_id bigint, text string")
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat", "en"), ("der hund", "de")] * 20)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit(train)).collect()}
    assert got[1] == "und" and "und" not in (got[2], got[3], got[4])


def test_toxicity_recall_and_harmless_words(spark):
    """Held-out toxic documents that are caught, and a listed insult that labels show to be an everyday word."""
    got = QUERIES["op5_toxicity"](spark, MID).toPandas()
    held = got.merge(duckdb.sql(f"select doc_id, toxic from '{MID}/labels.parquet'").df(), on="doc_id").query("held_out and toxic == 1")
    assert (held["predicted"] == 1).mean() > 0.5
    rows = [(i, "you total idiot and moron number %d" % i if i % 2 else "le train arrive en retard ce soir %d" % i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int"))
    assert "retard|" not in model.terms and "idiot|" in model.terms
