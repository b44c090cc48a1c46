"""Graph, merge, lookup and streaming operators against brute force and on hand-made tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths, text
from graphloom.operators import impact, incremental, resolve, symbols, telemetry
from graphloom.plans.closure import label_components, reach
from graphloom.plans.nodes import node, normal_path, same_node
from graphloom.plans.priority import nearest_before
from graphloom.sources import records
from graphloom.streaming import live


def brute_reach(edges, start, up, depth):
    seen, level = {start: 0}, [start]
    for d in range(1, depth + 1):
        level = {(a if up else b) for a, b in edges for n in level if (b if up else a) == n} - set(seen)
        seen.update(dict.fromkeys(level, d))
    return seen


@pytest.mark.parametrize("direction", ["up", "down"])
def test_reach_equals_brute_force_with_cycles(spark, direction):
    draw = random.Random(3)
    pairs = {(f"n{draw.randrange(25)}", f"n{draw.randrange(25)}") for _ in range(45)}
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sorted(pairs))], "edge_id bigint, src_key string, dst_key string")
    seeds = spark.createDataFrame([(0, "n1"), (1, "n7")], "seed_id bigint, key string")
    for depth in (1, 3, 30):
        got = {}
        for r in reach(edges, seeds, direction, depth).collect():
            got.setdefault(r.seed_id, {})[r.key] = r.depth
        assert got == {0: brute_reach(pairs, "n1", direction == "up", depth), 1: brute_reach(pairs, "n7", direction == "up", depth)}
    assert reach(edges, seeds.where("false"), direction).count() == 0


def test_components_with_lone_nodes(spark):
    got = {r.node: r.component for r in label_components(spark.createDataFrame([("b", "c"), ("c", "d"), ("x", "x")], "a string, b string"), spark.createDataFrame([(c,) for c in "abcdx"], "node string")).collect()}
    assert got == {"a": "a", "b": "b", "c": "b", "d": "b", "x": "x"}


def test_node_equality_has_wildcards(spark):
    def eq(a, b):
        return spark.range(1).select(same_node(a, b)).first()[0]

    f = lambda **k: node("FUNCTION", **{"file": "a", "function": "f", **k})
    assert eq(f(), f(class_="A")) and eq(f(class_="A"), f(class_="A", line=3)) and not eq(f(class_="A"), f(class_="B")) and not eq(f(line=1), f(line=2))
    assert eq(f(file=None), f(file=None)) and not eq(f(file=None), f())
    assert eq(node("DATABASE", model="m"), node("DATABASE", model="m", method="find")) and not eq(node("SQL", model="m"), node("SQL", model="m"))
    assert eq(node("ROUTE", route="/a", method="GET", file="x"), node("ROUTE", route="/a", method="GET")) and not eq(node("ROUTE", route="/a", method="GET"), node("ROUTE", route="/a", method="get"))
    assert not eq(f(), node("MIDDLEWARE", file="a", function="f"))


def graph_of(spark, rows):
    """rows: type, from (kind, name, class), to, confidence, is_test."""
    def col(prefix):
        return node(F.col(f"{prefix}.kind"), file=F.when(F.col(f"{prefix}.kind").isin("FUNCTION", "MIDDLEWARE"), F.concat(F.lit("f_"), f"{prefix}.name")), function=F.when(F.col(f"{prefix}.kind").isin("FUNCTION", "MIDDLEWARE"), F.col(f"{prefix}.name")), class_=F.col(f"{prefix}.cls"), route=F.when(F.col(f"{prefix}.kind") == "ROUTE", F.col(f"{prefix}.name")), method=F.when(F.col(f"{prefix}.kind") == "ROUTE", F.lit("GET")), model=F.when(F.col(f"{prefix}.kind") == "DATABASE", F.col(f"{prefix}.name")))

    raw = spark.createDataFrame([(i, t, a, b, c, test) for i, (t, a, b, c, test) in enumerate(rows)], "edge_id bigint, edge_type string, a struct<kind:string,name:string,cls:string>, b struct<kind:string,name:string,cls:string>, confidence string, is_test boolean")
    return raw.select("edge_id", "edge_type", col("a").alias("src"), col("b").alias("dst"), "confidence", "is_test", F.lit(None).cast("boolean").alias("observed"), F.lit(None).cast("string").alias("source"))


def fn(name, cls=None):
    return ("FUNCTION", name, cls)


def test_policies(spark):
    rows = [
        ("ROUTE_CALL", ("ROUTE", "/a", None), fn("ctl"), "resolved", False), ("FUNCTION_CALL", fn("ctl"), fn("svc", "S"), "resolved", False), ("DB_ACCESS", fn("svc"), ("DATABASE", "m", None), "resolved", False),
        ("ROUTE_CALL", ("ROUTE", "/b", None), fn("other"), "resolved", False), ("FUNCTION_CALL", fn("test"), fn("svc"), "resolved", True), ("FUNCTION_CALL", fn("maybe"), fn("svc"), "unobserved", False),
        ("FUNCTION_CALL", fn("svc"), fn("ctl"), "candidates", False),
    ]
    edges = graph_of(spark, rows)
    target = spark.range(1).select(F.lit(0).cast("bigint").alias("seed_id"), node("FUNCTION", file="f_svc", function="svc").alias("node"))
    run = lambda policy, **k: sorted((r.direction, r.depth, r.edge_id) for r in impact.resolve_impact(edges, target, policy, **k).collect())
    assert run("LOCAL_EDIT") == []
    assert run("SIGNATURE_CHANGE") == [("up", 1, 1), ("up", 1, 5)]
    assert run("SIGNATURE_CHANGE", include_tests=True) == [("up", 1, 1), ("up", 1, 4), ("up", 1, 5)]
    assert run("SIGNATURE_CHANGE", direction="DOWNSTREAM") == [("down", 1, 2), ("down", 1, 6)]
    assert run("DEFAULT", min_confidence="resolved") == [("down", 1, 2), ("up", 1, 1), ("up", 2, 0)]
    assert run("NO_SUCH_POLICY") == run("BUG_FIX") == run("DEFAULT") and ("up", 2, 6) in run("DEFAULT")
    assert run("DEPENDENCY_ONLY") == [] and {e for _, _, e in run("TAINT_FLOW")} == {1, 2, 5, 6}
    assert run("NEW_FEATURE") == run("FEATURE_ADDITION") == [("down", 1, 0), ("down", 2, 1), ("down", 3, 2)]
    assert [(r.src.route, r.depth) for r in impact.routes_by_model(edges, "m").collect()] == [("/a", 3)]


def test_trace_merge_is_idempotent_and_demotes(spark):
    edges = spark.createDataFrame([("a", "b", "candidates"), ("a", "c", "candidates"), ("x", "y", "resolved")], "src string, dst string, confidence string")
    trace = spark.createDataFrame([("a", "b", "t2", 3), ("a", "b", "t1", 1), ("q", "r", "t1", 1)], "src string, dst string, test string, count bigint")
    once = incremental.merge_trace(edges, trace, ["src", "dst"])
    twice = incremental.merge_trace(once, trace, ["src", "dst"])
    key = lambda df: sorted((r.src, r.dst, r.confidence, r.observed_count, tuple(r.observed_in), r.static_confidence) for r in df.collect())
    assert key(once) == key(twice) and ("a", "b", "observed", 4, ("t1", "t2"), "candidates") in key(once) and ("q", "r", "observed", 1, ("t1",), "trace-only") in key(once)
    pruned = {(r.dst): r.confidence for r in incremental.prune_fanout(once.withColumn("call_id", F.col("src"))).collect()}
    assert pruned == {"b": "observed", "c": "unobserved", "y": "resolved", "r": "observed"}


def test_update_equals_rebuild(spark):
    draw = random.Random(9)
    make = lambda: [(f"f{i}", f"h{draw.randrange(3)}", j) for i in range(20) for j in range(draw.randrange(3)) if draw.random() < 0.8]
    a, b = (spark.createDataFrame(make(), "file string, sha256 string, row int") for _ in range(2))
    digest = lambda df: incremental.definition_digest(df, ["sha256", "row"]).withColumnRenamed("digest", "sha256")
    updated = incremental.apply_update(a, b, incremental.hash_diff(digest(a), digest(b)))
    assert updated.exceptAll(b).count() == b.exceptAll(updated).count() == 0


def test_dependents_only_when_definitions_move(spark):
    d = lambda rows: spark.createDataFrame(rows, "file string, digest string")
    imports = spark.createDataFrame([("b", "a"), ("c", "a"), ("a", "c")], "file string, resolved_file string")
    changed = spark.createDataFrame([("a",)], "file string")
    assert incremental.dependents_to_update(imports, d([("a", "1")]), d([("a", "1")]), changed).count() == 0
    assert sorted(r.file for r in incremental.dependents_to_update(imports, d([("a", "1")]), d([("a", "2")]), changed).collect()) == ["b", "c"]


def test_reexports_named_before_star(spark):
    uses = spark.createDataFrame([("i", "x"), ("i", "y"), ("i", "z"), ("m", "x")], "file string, name string")
    re = spark.createDataFrame([("i", None, "star", None, True, 0), ("i", "x", "mid", "x2", False, 1), ("mid", None, "m", None, True, 0), ("star", "y", "i", "y", False, 0)], "file string, exported string, source_file string, original string, is_star boolean, pos int")
    have = spark.createDataFrame([("m", "x2"), ("star", "x"), ("m", "x")], "file string, name string")
    got = {(r.file, r.name): (r.target_file, r.target_name) for r in resolve.through_reexports(uses, re, have).collect()}
    assert got == {("i", "x"): ("m", "x2"), ("i", "y"): (None, None), ("i", "z"): (None, None), ("m", "x"): ("m", "x")}


def test_destructured_and_rest_arguments(spark):
    args = spark.createDataFrame([("c", "f", 0, "{a: 1, b}"), ("c", "f", 1, "x"), ("c", "f", 2, "y"), ("c", "f", 3, "z")], "call_id string, function string, pos int, value string")
    params = spark.createDataFrame([("f", 0, "destructured", "o", ["a", "b", "q"]), ("f", 1, "positional", "p", None), ("f", 2, "rest", "r", None)], "function string, pos int, group_type string, name string, keys array<string>")
    got = sorted((r.pos, r.value, r.parameter, r.kind) for r in resolve.argument_flow(args, params).collect())
    assert got == [(0, "1", "a", "destructured"), (0, "b", "b", "destructured"), (1, "x", "p", "positional"), (2, "y", "r", "rest"), (3, "z", "r", "rest")]


def test_nearest_definition(spark):
    calls = spark.createDataFrame([(1, "f", 10), (2, "f", 1), (3, "g", 1)], "id int, name string, line int")
    defs = spark.createDataFrame([("f", 3, "old"), ("f", 9, "new"), ("f", 20, "late")], "name string, start int, tag string")
    assert {r.id: r.tag for r in nearest_before(calls, defs, ["name"], "line", "start", ["start", "tag"], "id").collect()} == {1: "new", 2: "old", 3: None}


def test_path_and_name_functions(spark):
    df = spark.createDataFrame([("a\\b\\..\\c.py", "parseHTTPResponse2xx"), ("./src//x/tests/y.ts", "get_user_ID"), ("../../q", "x")], "p string, n string")
    rows = df.select(normal_path(F.col("p")).alias("p"), text.subwords(F.col("n")).alias("s"), paths.is_test(F.col("p")).alias("t")).collect()
    assert [r.p for r in rows] == ["a/c.py", "src/x/tests/y.ts", "../../q"]
    assert [r.s for r in rows] == [["parse", "http", "response", "xx"][:3], ["get", "user"], []] and [r.t for r in rows] == [False, True, False]
    est = spark.range(1).select(text.tokens(F.lit("")), text.tokens(F.lit("ab"), "gemini"), text.tokens(F.lit("a" * 100), "llama"), text.tokens(F.lit(None).cast("string"))).first()
    assert list(est) == [0, 1, 30, 0]
    at = spark.createDataFrame([("2024-01-02T03:04:05.123456Z",), ("2024-01-02T03:04:05.5Z",), ("2024-01-02T03:04:05",), ("no",)], "t string").select(text.iso_timestamp(F.col("t")).alias("t")).collect()
    assert at[0].t.microsecond == 123456 and at[2].t.second == 5 and at[3].t is None


def test_search_prefers_exact_names(spark):
    s = spark.createDataFrame([("a/cart.py", "total_price", "Cart"), ("b/user.py", "login", "User"), ("c/misc.py", "price_list", None)], "file string, name string, class string")
    lit = spark.createDataFrame([("c/misc.py", "could not log in the user")], "file string, text string")
    got = symbols.find_symbols(s, "login of the user fails: could not log in the user", lit, 3).collect()
    assert [r.file for r in got] == ["b/user.py", "c/misc.py"] and got[0].score > got[1].score and "name login" in got[0].reasons


def test_transcripts_and_snapshots(spark, tmp_path):
    lines = [json.dumps({"session_id": "s", "step_idx": i, "type": "MCP_TOOL", "content": "x", "created_at": "2024-01-01T00:00:0%d" % i, "tool_calls": json.dumps([{"name": "view", "args": a}])}) for i, a in enumerate([{"path": "p"}, '{"path": "q"}'])]
    (tmp_path / "t.jsonl").write_text("\n".join([lines[0], "{broken", lines[1]]))
    steps = records.read_transcripts(spark, str(tmp_path / "t.jsonl"))
    assert steps.count() == 2 and [r.args["path"] for r in records.tool_arguments(steps).orderBy("step_idx").collect()] == ["p", "q"]
    where = str(tmp_path / "snap")
    assert not records.has_snapshot(spark, where)
    for n in (1, 2):
        records.save_snapshot({"t": spark.range(n)}, where)
    assert records.load_snapshot(spark, where, "t").count() == 2
    (tmp_path / "trace.json").write_text(json.dumps({"version": 1, "files": {"a.py": "1", "b.py": "2"}, "edges": [{"from": {"file": "a.py", "function": "f"}, "to": {"file": "b.py", "function": "g"}, "test": "t", "count": 2}]}))
    edges, recorded = records.load_trace(spark, str(tmp_path / "trace.json"))
    now = spark.createDataFrame([("a.py", "1"), ("b.py", "3")], "file string, sha256 string")
    assert [r.stale for r in records.stale_edges(edges, recorded, now).collect()] == [True]


def test_change_feed_survives_a_repeated_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "file string, sha256 string"
    for n, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "2")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        live.change_feed(spark.readStream.schema(schema).parquet(source), target, "file", str(tmp_path / "state"), "sha256").awaitTermination()
    assert sorted(map(tuple, live.current(spark, target).collect())) == [("a", "2"), ("b", "1")]


def test_change_feed_replays_a_batch_and_orders_rows(spark, tmp_path):
    target, schema = str(tmp_path / "out"), "file string, sha256 string, seq int"
    put = lambda n, rows: live.apply_batch(spark.createDataFrame(rows, schema), n, target, "file", "sha256", "seq")
    rows = lambda: sorted((r.file, r.sha256) for r in live.current(spark, target).collect())
    put(0, [("a", "1", 1), ("b", "1", 1), ("c", "1", 1)])
    second = [("a", "9", 2), ("a", "2", 3), ("c", None, 4)]
    for _ in range(2):  # the second time as after a crash between the version and the stream's own commit
        put(1, second)
        assert rows() == [("a", "2"), ("b", "1")]
    put(2, [("d", "1", 5)])
    assert rows() == [("a", "2"), ("b", "1"), ("d", "1")] and live.versions(spark, target) == [1, 2]


def test_windows_of_a_transcript(spark):
    steps = spark.createDataFrame([("s", i, q) for i, q in enumerate([False, True, False, False, True, False])], "session string, i int, q boolean")
    got = [r.window_id for r in telemetry.task_windows(steps, "session", ["i"], F.col("q")).orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 1, 2]


def test_session_savings(spark):
    s = spark.createDataFrame([("a", 100, ["x", "y"]), ("b", 10, [])], "session_id string, tokens bigint, files array<string>")
    q = spark.createDataFrame([("a", 10, ["y"]), ("a", 15, ["y", "z"])], "session_id string, context_tokens bigint, files array<string>")
    got = {r.session_id: (r.queries, r.context_tokens, r.percent_less, r.files_of_either, r.files_of_both) for r in telemetry.session_savings(q, s).collect()}
    assert got == {"a": (2, 25, 75.0, 3, 1), "b": (0, 0, 100.0, 0, 0)}


def test_governance_order(spark):
    from graphloom.operators import governance as G

    rows = spark.createDataFrame([(True, True, 9, "fix the crash"), (False, True, 1, "add a test"), (False, False, 9, "rename it"), (False, False, 1, "hello")], "sec boolean, brk boolean, reach int, text string")
    score = G.confidence({"tests_pass": F.lit(True), "security": F.col("sec"), "breaking": F.col("brk")})
    got = [tuple(r) for r in rows.select(score, G.policy(score, F.col("sec"), F.col("brk"), F.col("reach")), G.intent(F.col("text")), G.risk(F.col("reach"))).collect()]
    assert got == [(0.2, "BLOCK", "BUG_FIX", "HIGH"), (0.5, "MANUAL_REVIEW", "TEST", "MEDIUM"), (0.7, "MANUAL_REVIEW", "REFACTOR", "HIGH"), (0.7, "APPROVE", "OTHER", "MEDIUM")]
