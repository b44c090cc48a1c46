"""Exact and near deduplication of documents and lines against brute force, and their edge cases."""

import hashlib
import random
from math import comb

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, line_dedup, near_dedup, sketching
from graphloom.llm.common import components, open_groups
from graphloom.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, kept boolean, n_shingles int, component_id string, nth int, size int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)


def corpus(seed=1, groups=12):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [draw.choice(words) for _ in range(draw.choice([3, 8, 40, 90, 200]))]
        for _ in range(draw.randrange(1, 7)):
            copy = list(base)
            for _ in range(draw.randrange(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((n, draw.choice([" ", "\n", "  "]).join(copy)))
            n += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_equals_all_pairs(spark, percent):
    rows = [*corpus(3), (900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (905, "one two three")]
    got = near_dedup.near_dedup(frame(spark, rows), percent=percent).toPandas().sort_values("id")
    want = near_dedup.reference_components(rows, 5, percent).sort_values("doc_id")
    assert got["id"].tolist() == want["doc_id"].tolist()
    for name in ("n_shingles", "component_id", "kept"):
        assert got[name].tolist() == want[name].tolist()


def test_near_dedup_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    draw = random.Random(5)
    base = [f"x{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        copy = list(base)
        copy[draw.randrange(120)] = f"y{i}"
        copy[draw.randrange(120)] = f"z{i}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_dedup(frame(spark, rows), percent=85).toPandas().sort_values("id")
    assert got["component_id"].tolist() == near_dedup.reference_components(rows, 5, 85).sort_values("doc_id")["component_id"].tolist()


def test_near_dedup_in_large_clusters(spark, monkeypatch):
    """A cluster of copies around one lead, and chains whose ends never meet, dealt by whole clusters and by buckets; ids may be negative."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "LARGE", 4)
    draw = random.Random(6)
    base = [f"x{k}" for k in range(150)]
    rows = [(-1, " ".join(base))]
    for i in range(20):
        copy = list(base)
        copy[draw.randrange(150)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    words = [f"c{k}" for k in range(400)]
    rows += [(100 + i, " ".join(words[5 * i : 5 * i + 100])) for i in range(12)]  # neighbours have 91 of 101 shingles in common
    rows += [(200 + i, " ".join(words[14 * i : 14 * i + 100])) for i in range(8)]  # close, but not enough
    got = near_dedup.near_dedup(frame(spark, rows), percent=80).toPandas().sort_values("id")
    assert got["component_id"].tolist() == near_dedup.reference_components(rows, 5, 80).sort_values("doc_id")["component_id"].tolist()


def test_open_groups_choose_the_cheaper_way(spark):
    """A chain of small buckets is compared by its buckets, a cluster in one bucket as a whole; equal buckets count once; what the lead settled is left out."""
    chain = [(n, 0) for n in range(30)] + [(n, 100) for n in range(100, 110)] + [(200, 200), (201, 200)]
    member = [(n, 1000 + n // 3) for n in range(30)] + [(n, 2000 + n // 3) for n in range(30)] + [(n, b) for n in range(100, 110) for b in (1, 2, 3)]
    rest = [(n,) for n in range(1, 30)] + [(n,) for n in range(101, 110)] + [(201,)]
    clusters = spark.createDataFrame(chain, "node bigint, component bigint")
    got = open_groups(clusters, spark.createDataFrame(rest, "node bigint"), spark.createDataFrame(member, "node bigint, bucket bigint"), 5).collect()
    assert {r.component for r in got} == {0, 100}
    assert {r.part for r in got if r.component == 100} == {0}
    assert {(r.part, r.node) for r in got if r.component == 0} == {(1000 + n // 3, n) for n in range(30)}


def test_near_dedup_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "a b c", 1, 2, 3), (3, None, 1, 2, 3)], "doc_id bigint, text string, found int, gone_id int, component_id int")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_near_dedup_edges(spark):
    text = " ".join(f"t{k}" for k in range(30))
    got = {(r.id, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark, [(5, text), (5, text), (2, text), (None, text), (9, None)])).collect()}
    assert got == {(5, 2, False), (2, 2, True), (None, None, True), (9, 9, True)}
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0
    kept = near_dedup.keep_one(frame(spark, [(5, text), (2, text), (None, text)]))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]


def test_long_texts_hash_alike():
    """Prefix sums go over pieces; a word hashes the same wherever it stands, and as it would alone."""
    import pyarrow as pa

    word = "Abc-é日" * 40
    text = " ".join(["filler"] * 300_000 + [word])
    data, offsets = sketching.string_buffers(pa.array([text, None, word.replace("A", "a"), ""]))
    hashes, first = sketching.word_hashes(data, offsets)
    assert first.tolist() == [0, 300_001, 300_001, 300_002, 300_002]
    assert hashes[300_000] == hashes[300_001] and len(set(hashes[:300_000].tolist())) == 1


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(0)
    pool = draw.integers(0, 2**63, 2000).astype(np.uint64)
    for share in (0.3, 0.8, 0.95):
        both = int(1000 * share)
        a, b = pool[:1000], np.concatenate([pool[:both], pool[1000 : 2000 - both]])
        row = np.repeat([0, 1], [len(a), len(b)])
        s = sketching.fast_similarity_sketch(row, np.concatenate([a, b]), 2, 512)
        jaccard = both / (2000 - both)
        assert abs((s[0] == s[1]).mean() - jaccard) < 0.09
    tiny = sketching.fast_similarity_sketch(np.array([0, 2]), np.array([7, 7], np.uint64), 3, 64)
    assert (tiny[0] == tiny[2]).all() and (tiny[1] == 0).all()


def test_exact_dedup_equals_sql(spark):
    rows = [(3, "a"), (7, "a"), (5, "A"), (1, None), (2, ""), (None, "a"), (7, "a"), (8, "é" * 50_000), (9, "é" * 50_000), (None, None)]
    docs = frame(spark, rows)
    got = sorted((r.id or -1, r.keep_id or -1, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted((r[0] or -1, r[1] or -1, *r[2:]) for r in con.sql(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact_dedup.OP2_SQL})").fetchall())
    assert got == want
    assert got[-1][4] == hashlib.sha256(("é" * 50_000).encode()).hexdigest()


def test_exact_dedup_of_a_text_with_very_many_copies(spark):
    rows = [(i, "same") for i in range(3000)] + [(5000 + i, f"t{i}") for i in range(50)]
    got = exact_dedup.exact_dedup(frame(spark, rows))
    assert got.where("kept").count() == 51
    assert {(r.keep_id, r.group_size) for r in got.where("id < 3000").collect()} == {(2999, 3000)}
    kept = exact_dedup.keep_one(frame(spark, rows))
    assert kept.count() == 51 and kept.where("doc_id < 3000").first().doc_id == 2999
    lower = exact_dedup.exact_dedup(frame(spark, [(1, "Ab"), (2, "aB")]), normalise=F.lower)
    assert [r.kept for r in lower.orderBy("id").collect()] == [False, True]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == exact_dedup.keep_one(frame(spark, [])).count() == 0


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def lines_corpus():
    draw = random.Random(4)
    words = [f"word{k}" for k in range(300)]
    base = [" ".join(draw.choice(words) for _ in range(draw.choice([1, 2, 6, 15, 40]))) for _ in range(25)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(draw.randrange(1, 8)):
            line = draw.choice(base).split(" ")
            if draw.random() < 0.5:
                line[draw.randrange(len(line))] = draw.choice(words)
            lines.append((" " * draw.randrange(3) + " ".join(line)).capitalize())
        rows.append((i, "\n".join(lines)))
    return rows


def test_line_dedup_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    monkeypatch.setattr(line_dedup, "LARGE", 4)
    rows = [*lines_corpus(), (-7, "a line of its own\nand one more of a negative document"), (100, ""), (101, "\n \nsame line here\n"), (102, "SAME line here"), (103, None)]
    got = {r.id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    want = line_dedup.reference_lines(rows)
    assert {i: t for i, t in got.items() if t is not None} == want and got[103] is None
    assert got[101] == "\n \nsame line here\n" and got[102] == ""


def test_line_dedup_edges(spark):
    rows = [(2, "x y z"), (2, "x y z"), (1, "x y z"), (None, "x y z"), (None, "x y z")]
    got = sorted((r.id or 0, r.n_lines, r.n_kept) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == [(0, 1, 1), (0, 1, 1), (1, 1, 1), (2, 1, 0), (2, 1, 0)]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


LONG = "the harbour keeps its boats under canvas until the storms of march have passed and the nets are dry again"


def unspaced():
    """Pairs of lines without spaces (or with tabs): equal in their first eight characters, and near copies that differ in an early one."""
    draw = random.Random(8)
    tail = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789/") for _ in range(90)) for _ in range(6)]
    kana = "".join(chr(0x3042 + draw.randrange(80)) for _ in range(90))
    other = "".join(chr(0x3042 + draw.randrange(80)) for _ in range(90))
    third = "".join(chr(0x3042 + draw.randrange(80)) for _ in range(90))
    far = [("https://example.com/a/1", "https://example.com/b/2"), ("https://" + tail[0], "https://" + tail[1]), ("id\tname\t" + tail[0].replace("/", "\t"), "id\tname\t" + tail[1].replace("/", "\t")), ("日本語の文章です。" + kana, "日本語の文章です。" + other), ("10 oranges", "20 oranges"), ("𝔘𝔫𝔦𝔠𝔬𝔡𝔢𝔰" + tail[2], "𝔘𝔫𝔦𝔠𝔬𝔡𝔢𝔰" + tail[3])]
    near = [("x" + tail[4], "y" + tail[4]), ("日" + third, "本" + third), ("a\t" + tail[5].replace("/", "\t"), "b\t" + tail[5].replace("/", "\t")), (LONG, LONG.replace("boats", "boots"))]
    return far, near


def test_line_dedup_sees_every_character(spark):
    far, near = unspaced()
    rows = [(i, line) for i, line in enumerate(line for pair in far + near for line in pair)]
    got = {r.id: r.n_kept for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [got[i] for i in range(2 * len(far))] == [1] * 2 * len(far)
    assert [got[2 * len(far) + i] for i in range(2 * len(near))] == [1, 0] * len(near)
    assert {i: t for i, t in line_dedup.reference_lines(rows).items() if t} == {i: t for i, t in rows if got[i]}


def test_line_query_on_the_table(spark, sf_dir):
    """n_lines, n_kept and removed of the query against brute force over all pairs of lines."""
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    want = line_dedup.reference_lines(list(texts.items()))
    got = {r.doc_id: r for r in QUERIES["op7_line_dedup"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        lines = text.split("\n")
        gone = {int(x) for x in got[i].removed.split(",") if x}
        assert "\n".join(line for p, line in enumerate(lines) if p not in gone) == want[i]
        assert (got[i].n_lines, got[i].n_kept) == (len(lines), len(lines) - len(gone))


def test_near_dedup_query_on_the_table(spark):
    """All links at 0.85 among the documents of a table, by brute force: none is missed."""
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = QUERIES["op1_minhash_near_dedup"](spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id")
    want = near_dedup.reference_components(rows, 5, 85).sort_values("doc_id")
    for name in ("doc_id", "n_shingles", "component_id", "kept"):
        assert got[name].tolist() == want[name].tolist()


def test_line_dedup_bands_miss_hardly_any_pair_at_the_threshold():
    assert (1 - 0.8**line_dedup.ROWS) ** line_dedup.RANGES <= 1e-5


def test_line_dedup_sorts_hashes_outside_the_interpreted_generator(spark):
    """Only the hashes themselves are made in a generator, which Spark interprets; they are sorted and made distinct in a compiled projection after it."""
    plan = line_dedup.hashed(spark.createDataFrame([(1, "one two three")], "key bigint, line string"), "line")._jdf.queryExecution().optimizedPlan().toString()
    made = [x for x in plan.split("\n") if "Generate" in x]
    assert made and not any("sort_array" in x or "array_distinct" in x for x in made) and "sort_array(array_distinct(" in plan


def test_line_dedup_least_hashes_turn_down_no_similar_pair(spark, monkeypatch):
    """similar() against sets, for pairs on both sides of the threshold; the least hashes alone turn down the far ones, so that whole sets aren't compared for them."""
    draw = random.Random(4)
    new = lambda n: [draw.randrange(-(2**63), 2**63) for _ in range(n)]
    rows = []
    for n in (1, 5, 31, 32, 33, 40, 100, 400):
        for _ in range(60):
            both, rest = new(n), new(max(1, n // 4))
            part = draw.randrange(len(rest) + 1)
            rows.append((sorted(both + rest[:part]), sorted(both + rest[part:])))
        rows += [(sorted(x := new(n)), sorted(x[: n // 3] + new(n - n // 3))) for _ in range(20)]
    ratio = [len(set(a) & set(b)) * 100 >= 80 * len(set(a) | set(b)) for a, b in rows]
    assert {True, False} == set(ratio)
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<bigint>, b array<bigint>")
    got = dict(pairs.select("i", line_dedup.similar(F.col("a"), F.col("b"), 80)).collect())
    assert [got[i] for i in range(len(rows))] == ratio
    need = line_dedup.fewest(80)
    assert 0 < need and sum(comb(line_dedup.LEAST, k) * 0.8**k * 0.2 ** (line_dedup.LEAST - k) for k in range(need)) <= line_dedup.MISS
    far = [len(set(a[: line_dedup.LEAST]) & set(b[: line_dedup.LEAST])) < need for (a, b), x in zip(rows, ratio) if not x and len(a) == len(b) == 400]
    assert sum(far) >= 10


def test_line_dedup_sends_bitmaps_of_bounded_size_and_loses_no_line(spark, monkeypatch):
    """The keys of candidate lines are not sent through the driver: bitmaps are, and their number has a bound. All lines with a key stay, and few others unless there are too many keys."""
    lines = spark.range(40_000).select(F.xxhash64("id").alias("key"), F.col("id").cast("string").alias("line"))
    keys = lines.where("cast(line as int) % 8 = 0").select("key")
    for most, others in ((1024, 2_000), (2, 10_000)):
        monkeypatch.setattr(line_dedup, "PIECES", most)
        bitmaps, pieces = line_dedup.key_bitmaps(keys)
        assert pieces <= most and bitmaps.count() <= pieces and {len(r.bitmap) for r in bitmaps.collect()} == {4096}
        got = [int(r.line) for r in line_dedup._by_key(lines, keys).collect()]
        assert len(got) == len(set(got)) <= 5_000 + others and set(range(0, 40_000, 8)) <= set(got)
    assert line_dedup._by_key(lines, keys.where("false")).count() == 0


def test_line_dedup_buckets_are_not_made_again_for_a_filter(spark):
    lines = line_dedup.hashed(spark.createDataFrame([(1, "one two three")], "key bigint, line string"), "line")
    plan = line_dedup.members(lines, "key")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("xxhash64" in x for x in plan.split("\n") if "Filter" in x)
