"""BPE, decontamination, secrets and sharding against brute force, and their edge cases."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe, decontaminate, secrets, sharding
from graphloom.llm.queries import QUERIES

MID = "/root/testdata/sf0.01"
PATH, PATTERN = bpe.public_files()
CODEC = bpe.codec(PATH, PATTERN)
TRUTH = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aeth  \n\t'sl1!é日ß\u00a0\u2003")), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_bpe_is_that_of_the_library(text):
    ids = CODEC.encode(text)
    assert ids == TRUTH.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_bpe_of_long_pieces_and_streams(monkeypatch):
    for text in ("ab" * 3000, " " * 3000 + "x", "é" * 2000, "a \n b  c\n\n d" * 50):
        assert CODEC.encode(text) == TRUTH.encode_ordinary(text)
    monkeypatch.setattr(bpe, "STREAM_CHARS", 10)
    monkeypatch.setattr(bpe, "STREAM_PIECES", 3)
    text = "The quick  brown fox, isn't it?\n  Yes." * 5
    assert CODEC.encode(text) == TRUTH.encode_ordinary(text)
    n, said, back, ids = CODEC.digests(text, True)
    assert (n, ids) == (len(ids), TRUTH.encode_ordinary(text))
    assert said == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and back == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text", ["a  ", "x\n ", "x\t ", "  ", "   ", "a b  ", "a ", " ", "a\u2003 "])
def test_bpe_pieces_at_the_end_do_not_depend_on_the_vocabulary(tmp_path, text):
    tokens = [bytes([b]) for b in range(256)] + [b"  ", b"\n ", b"\t ", b"   "]
    (tmp_path / "own").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    own = bpe.Codec(str(tmp_path / "own"), PATTERN)
    truth = tiktoken.Encoding("small", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert own.encode(text) == truth.encode_ordinary(text)


def test_bpe_of_another_pattern(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"a ", b"a b"]
    (tmp_path / "own").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    own = bpe.Codec(str(tmp_path / "own"), "[a-z ]+|.")
    truth = tiktoken.Encoding("odd", pat_str="[a-z ]+|.", mergeable_ranks=own.ranks, special_tokens={})
    for text in ("a b", "xa b a", "a  b"):
        assert own.encode(text) == truth.encode_ordinary(text)


def test_bpe_query(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{MID}/documents.parquet'").fetchall())
    got = QUERIES["op4_byte_bpe"](spark, MID).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = TRUTH.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "hi there", 5)], "doc_id bigint, text string, ids int")
    got = {(r.doc_id, r.n_tokens, tuple(r.ids)) for r in bpe.encode_texts(docs, PATH, PATTERN).collect()}
    assert got == {(1, 0, ()), (None, 2, tuple(TRUTH.encode_ordinary("hi there")))}
    none = hashlib.sha256(b"").hexdigest()
    assert {(r.ids_sha256, r.decoded_sha256) for r in bpe.encode_texts(docs.where("doc_id = 1"), PATH, PATTERN).collect()} == {(none, none)}
    assert bpe.encode_texts(docs.where("false"), PATH, PATTERN).count() == 0


def brute_tiles(item, text, k):
    """Greedy string tiling by trying all pairs of places, longest match first."""
    marked_item, marked_text, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and a + n not in marked_item and b + n not in marked_text:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < k:
            return total
        n, a, b = best
        marked_item.update(range(a, a + n))
        marked_text.update(range(b, b + n))
        total += n


def test_tiling_equals_brute_force():
    draw = random.Random(7)
    for _ in range(60):
        words = [f"w{k}" for k in range(draw.choice([3, 8, 40]))]
        item, text = ([draw.choice(words) for _ in range(n)] for n in (24, 40))
        if draw.random() < 0.6:
            at, cut = draw.randrange(10), draw.randrange(6, 18)
            text[at : at + 24] = item[cut:] + item[:cut]
        items = decontaminate.Items([(1, " ".join(item))], 5)
        _, share, _, tiles = items.judge(" ".join(text), 0.6)
        assert abs(share * 24 - brute_tiles(item, text, 5)) <= 0.01 or len(words) == 3
        assert share * 24 >= brute_tiles(item, text, 5) - 5  # of equally long matches either may go first, which matters with three words only
        for a, b, n in tiles:
            assert item[a : a + n] == text[b : b + n]


def test_contamination(spark):
    a, b = " ".join(f"alpha{k}" for k in range(30)), " ".join(f"beta{k}" for k in range(20))
    swapped = " ".join([*a.split()[15:], "and then", *a.split()[:15]])
    part = " ".join(a.split()[:12])
    bench = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "too short"), (None, "five words that are nothing special")], "item_id bigint, text string")
    rows = [(1, f"Before. {a.upper()}, after"), (2, swapped), (3, part), (4, None), (5, ""), (6, "too short"), (7, f"{b} {a}"), (None, b), (1, "clean")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, coverage int")
    for block in (1000, 10):
        got = [(r.doc_id, r.n_items, round(r.coverage, 2), r.item_id) for r in decontaminate.contamination(docs, bench, block_words=block).collect()]
        assert got == [(1, 1, 1.0, 1), (2, 1, 1.0, 1), (3, 0, 0.4, 1), (4, 0, 0.0, None), (5, 0, 0.0, None), (6, 0, 0.0, None), (7, 2, 1.0, got[6][3]), (None, 1, 1.0, 2), (1, 0, 0.0, None)]
        left = decontaminate.drop_contaminated(docs, bench, block_words=block)
        assert left.columns == docs.columns and [r.text for r in left.collect()] == [part, None, "", "too short", "clean"]
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0


def test_a_repeated_word_costs_no_memory(monkeypatch):
    monkeypatch.setattr(decontaminate, "SEEDS", 500)
    items = decontaminate.Items([(1, "a " * 200), (2, "b a " * 40)], 5)
    n, share, item, tiles = items.judge("x " + "a " * 3000 + "b a " * 50, 0.6)
    assert (n, share, item) == (2, 1.0, 1) and tiles == [(0, 1, 200)]


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Forty two"), (2, "forty-two!"), (3, "blue"), (4, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "It is forty two."), (2, "two forty"), (3, "BLUE sky, forty two"), (4, None), (5, "bluebird")], "doc_id bigint, text string")
    for words in (1000, 1):
        got = {r.doc_id: (r.n_items, r.item_id) for r in decontaminate.contamination(docs, bench, block_words=words, short_items=True).collect()}
        assert got == {1: (2, 1), 2: (0, None), 3: (3, 1), 4: (0, None), 5: (0, None)}
        left = decontaminate.drop_contaminated(docs, bench, block_words=words, short_items=True)
        assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5]


def test_decontamination_of_the_table(spark):
    """The query against plain tiling of every document and item that share a window, and the join of seeds against the broadcast."""
    texts = dict(duckdb.sql(f"select doc_id, text from '{MID}/documents.parquet'").fetchall())
    items = duckdb.sql(f"select item_id, text from '{MID}/benchmark.parquet'").fetchall()
    got = {r.doc_id: (r.n_items, round(r.coverage, 9), r.item_id) for r in QUERIES["op10_benchmark_decontamination"](spark, MID).collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    cut = [(i, decontaminate.words_of(t), grams(decontaminate.words_of(t))) for i, t in items]
    for doc, text in texts.items():
        words = decontaminate.words_of(text)
        own = grams(words)
        shares = []
        for i, w, g in cut:
            if own & g:
                near = sorted({x for k in range(len(words) - 4) if tuple(words[k : k + 5]) in g for x in range(k, k + 5)})
                text_part = [words[x] if x in set(near) else f"\0{x}" for x in range(near[0], near[-1] + 1)]
                shares.append((brute_tiles(w, text_part, 5) / len(w), i))
        n = sum(s >= 0.6 for s, _ in shares)
        best = min(shares, key=lambda s: (-s[0], s[1]), default=(0.0, None))
        assert got[doc] == (n, round(best[0], 9), best[1])
    docs, bench = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "benchmark"))
    other = {r.doc_id: (r.n_items, round(r.coverage, 9), r.item_id) for r in decontaminate.contamination(docs, bench, block_words=1, short_items=True).collect()}
    assert other == got


def test_base_secrets_of_the_table(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{MID}/documents.parquet'").fetchall())
    got = QUERIES["op6_secret_scan"](spark, MID).collect()
    assert len(got) == len(texts)
    for r in got:
        base = secrets.brute_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3)) and r.base_sha256 == secrets.digest(base)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "Secret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "abcdef123", "x", "é", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeefcafe", "\n", "ſecret", "\u212a"]), max_size=14))
def test_base_secrets_equal_their_definition(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == secrets.brute_base(text)


WEAK = "q7Zk39fLm2Xv8RtB41Ws"


def kinds(text):
    base = secrets.base_spans(text)
    return [secrets.KINDS[k] for _, k, _ in sorted([*base, *secrets.linked_spans(text, base)])]


def test_weak_parts_are_linked_only_together():
    assert kinds(f"value {WEAK} stands alone") == []
    assert kinds(f"user = alice\nvalue {WEAK}") == ["key_id", "weak_secret"]
    assert kinds(f"user = alice\n\nvalue {WEAK}") == []
    assert kinds(f"user = alice {'x ' * 300} {WEAK}") == []
    assert kinds(f"https://db.example.com/x {WEAK}") == ["weak_secret"]
    assert kinds(f"https://db.example.com/x {WEAK} login: bobby") == ["endpoint", "weak_secret", "key_id"]
    assert kinds("https://db.example.com/x login: bobby") == []
    assert kinds("AKIA" + "A" * 16 + f" {WEAK}") == ["access", "weak_secret"]
    assert kinds("password=hunter22 user=alice") == ["assign", "key_id"]


def test_gaps_are_measured_between_the_ends_of_parts():
    long = "Ab3" * 200
    assert kinds(f"password={long} {'x ' * 100} user = alice") == ["assign", "key_id"]
    assert kinds(f"user = alice {'x ' * 100} password={long}") == ["key_id", "assign"]
    assert kinds(f"{WEAK * 30} {'x ' * 100} user = alice") == ["weak_secret", "key_id"]
    assert kinds(f"password={long}\n\nuser = alice") == ["assign"]
    assert kinds(f"password={long} {'x ' * 300} user = alice") == ["assign"]


def test_prefixes_of_access_identifiers_are_capitals():
    for text in (f"akiaabcd1 {WEAK}", f"x: akiaabcd1 {WEAK}", f"many Asiatics wrote {WEAK}", f"x: Asiatics {WEAK}"):
        assert kinds(text) == []
    assert kinds(f"ASIAABCD1 {WEAK}") == ["key_id", "weak_secret"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["user=alice", "login: bob99", "AKIA", "ASIAQ7RT", WEAK, "Zq8" * 9, "password=hunter22", "https://a.b/c", "host: db.io", "x " * 30, " ", "\n", "\n \n", "\n\n", "é "]), max_size=12), st.sampled_from([20, 400, None]))
def test_links_equal_brute_force(parts, reach):
    text = "".join(parts)
    base = secrets.base_spans(text)
    assert sorted(secrets.linked_spans(text, base, reach)) == secrets.brute_links(text, base, reach)


def test_secret_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "é password=hunter22", 0), (1, "", 0)], "doc_id bigint, text string, spans int")
    got = {(r.doc_id, tuple((s.kind, s.start, s.end, s.base) for s in r.spans)) for r in secrets.scan(docs).collect()}
    assert got == {(1, ()), (None, (("assign", 2, 19, True),))}
    assert secrets.scan(docs.where("false")).count() == 0


def heap_loads(classes, shards):
    """Loads, and how many of each class each shard gets, by giving every group to the least loaded shard."""
    load, given_to = [0.0] * shards, []
    for size, n in classes:
        given_to.append([0] * shards)
        for _ in range(n):
            k = min(range(shards), key=lambda i: (load[i], i))
            load[k] += size
            given_to[-1][k] += 1
    return load, given_to


def test_schedule_is_the_heap():
    """Counts that aren't poured equal the heap's one by one; poured ones give loads as level as the heap's."""
    draw = random.Random(1)
    for shards in (1, 3, 40):
        few = sorted(((float(draw.randrange(1, 5000)), draw.choice([1, 2, 4 * shards])) for _ in range(40)), reverse=True)
        assert list(sharding.schedule(few, shards)) == heap_loads(few, shards)[1]
        classes = sorted(((float(draw.randrange(1, 5000)), draw.choice([1, 2, 30, 700])) for _ in range(40)), reverse=True)
        load, _ = heap_loads(classes, shards)
        got = list(sharding.schedule(classes, shards))
        assert [sum(g) for g in got] == [n for _, n in classes]
        final = [sum(size * g[k] for (size, _), g in zip(classes, got, strict=True)) for k in range(shards)]
        assert np.allclose(sorted(final), sorted(load), atol=classes[-1][0] + 1e-6)


def test_shards_of_the_table(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{MID}/documents.parquet'").fetchall())
    got = QUERIES["op9_lpt_sharding"](spark, MID).toPandas()
    assert sorted(got["doc_id"]) == sorted(texts)
    got["text"] = got["doc_id"].map(texts)
    assert (got["size"] == got["text"].map(lambda t: len(t.encode()) + 16)).all() and (got["text_crc32"] == got["text"].map(lambda t: zlib.crc32(t.encode()))).all()
    assert (got.groupby("text")["shard"].nunique() == 1).all()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 40 and load.max() <= 1.02 * load.min() + 64
    assert all(sorted(slots) == list(range(len(slots))) for _, slots in got.groupby("shard")["slot"])


@pytest.mark.parametrize("shards", [1, 4])
def test_shard_edges(spark, shards):
    rows = [(1, None, 9), (2, "", 9), (None, "a", 9), (3, "a", 9), (3, "a", 9), (4, "b" * 1000, 9)] + [(10 + i, f"t{i:02}", 9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = sharding.lpt_shards(docs, shards).toPandas()
    assert len(got) == len(rows) and got["shard"].between(0, shards - 1).all()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    assert got[got["id"] == 1].iloc[0][["size", "text_crc32"]].tolist() == [16, 0]
    same = got[got["text_crc32"] == zlib.crc32(b"a")]
    assert len(same) == 3 and same["shard"].nunique() == 1
    assert sharding.lpt_shards(docs.where("false"), shards).count() == 0
