"""Queries of the code family: parts, orders and pages stand for calls, definitions, views and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as T
from ..operators import file_graph as G
from ..operators import registry as R
from ..operators import resolve as V
from ..operators import scoring as S
from ..session import table
from .tpch_graph import edges as graph_edges
from .tpch_graph import edges_sql


def _call(column: str = "p_partkey"):
    """Five forms of an expression, by the key of a part."""
    k = F.col(column) % 5
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    made = [F.concat(name, F.lit(".run(a, b)")), F.concat(F.lit("await go("), name, F.lit("(1), 2)")), F.concat(F.lit("x.of("), name, F.lit(").then((y) => z) ")), name, F.concat(F.lit("new "), name, F.lit("(1)"))]
    return F.coalesce(*[F.when(k == i, e) for i, e in enumerate(made)])


def split_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.split_call(_call()).alias("c")).select("p_partkey", "c.head", "c.name", "c.args")


SPLIT_SQL = """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, replace(p_name, ' ', '_') AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN n WHEN 2 THEN 'x.of(' || n || ')' END AS head, CASE k WHEN 0 THEN 'run' WHEN 1 THEN 'go' WHEN 2 THEN 'then' END AS name,
       CASE k WHEN 0 THEN 'a, b' WHEN 1 THEN n || '(1), 2' WHEN 2 THEN '(y) => z' END AS args FROM p"""


def _definition() -> tuple:
    """Source of a definition on line 4, in Python for even parts, with a comment or docstring."""
    python = F.col("p_partkey") % 2 == 0
    py = F.concat(F.lit("import os\n\n\ndef load(path,\n         mode):\n    \"\"\""), F.col("p_name"), F.lit(".\"\"\"\n    return path\n"))
    js = F.concat(F.lit("/**\n * "), F.col("p_type"), F.lit(" loader\n */\nfunction load(path,\n  mode) {\n  return path\n}\n"))
    return F.when(python, py).otherwise(js), F.lit(4), python


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, line, python = _definition()
    return table(spark, sf_dir, "part").select("p_partkey", T.signature(content, line, python).alias("signature"), T.first_doc_line(content, line, python).alias("doc"))


SIGNATURES_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'def load(path, mode):' ELSE 'function load(path, mode) {' END AS signature,
CASE WHEN p_partkey % 2 = 0 THEN p_name || '.' ELSE p_type || ' loader' END AS doc FROM part"""


def numbered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as numbered views, read back: the code, and the numbers of the lines."""
    rows = F.split("text", "\n")
    view = F.concat(F.lit("File: x\n"), F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n"))
    seen = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", view.alias("view"))
    lines = T.viewed_lines(F.col("view"))
    return seen.select("doc_id", F.md5(F.encode(T.viewed_code(F.col("view")), "UTF-8")).alias("code_md5"), F.size(lines).cast("bigint").alias("n"), F.array_max(F.transform(lines, lambda x: x["number"])).cast("bigint").alias("last"))


VIEWS_SQL = "SELECT doc_id, md5(text) AS code_md5, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n, CAST(len(string_split(text, chr(10))) AS BIGINT) AS last FROM documents WHERE text IS NOT NULL"


def virtual_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("keep "), F.col("p_name"), F.lit(" / "), F.col("p_type"), F.lit(" / "), F.col("p_name"))
    patch = F.concat(F.lit("--- a\n+++ b\n-"), F.col("p_name"), F.lit("\n+"), F.col("p_brand"), F.lit("\n context\n+end"))
    return table(spark, sf_dir, "part").select("p_partkey", T.virtual_patch(code, F.when(F.col("p_size") > 10, patch).otherwise(F.lit("-nothing"))).alias("patched"))


PATCHES_SQL = """SELECT p_partkey, CASE WHEN p_size > 10 THEN replace('keep ' || p_name || ' / ' || p_type || ' / ' || p_name, p_name, '') || chr(10) || p_brand || chr(10) || 'end'
ELSE 'keep ' || p_name || ' / ' || p_type || ' / ' || p_name END AS patched FROM part"""


def target_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("ROUTE:get:/p/"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("FUNCTION:f"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", T.target_task(target, F.lit("DEFAULT")).alias("task"))


TASKS_SQL = "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Implement/Fix route: GET /p/' || page_id || ' (DEFAULT)' ELSE 'Task target: FUNCTION:f' || page_id || ' (DEFAULT)' END AS task FROM pages"


def _symbol(column):
    """Names of calls, the trusted ones among them, by a key."""
    names = [*R.TRUSTED, "lodash.merge", "jwt.decode"]
    return F.element_at(F.array(*map(F.lit, names)), (column % len(names)).cast("int") + 1)


def trusted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = _symbol(F.col("l_partkey"))
    calls = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", symbol.alias("symbol"))
    return calls.withColumn("category", R.trust_category(F.col("symbol"))).groupBy("symbol", "category").agg(F.count("*").alias("n")).withColumn("trusted", F.col("category").isNotNull())


TRUSTED_SQL = """WITH r AS (SELECT * FROM (VALUES (0, 'bcrypt.hash', 'CRYPTO'), (1, 'crypto.randomBytes', 'CRYPTO'), (2, 'validator.escape', 'SANITIZER'), (3, 'validator.normalizeEmail', 'SANITIZER'), (4, 'jwt.sign', 'AUTH'),
(5, 'jwt.verify', 'AUTH'), (6, 'express.Router', 'FRAMEWORK'), (7, 'lodash.merge', NULL), (8, 'jwt.decode', NULL)) t(k, symbol, category))
SELECT symbol, category, count(*) AS n, category IS NOT NULL AS trusted FROM lineitem JOIN r ON l_partkey % 9 = k GROUP BY symbol, category"""

_SOURCES = ["express", "@Nest/common", "pg/lib", "lodash", "./local", "Mongoose"]


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, nations as projects; what a file imports goes by its key."""
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), ((F.col("c_custkey") * (F.col("c_nationkey") + 1)) % len(_SOURCES)).cast("int") + 1)
    return table(spark, sf_dir, "customer").where("c_nationkey is not null").select(F.col("c_nationkey").alias("project"), source.alias("source"))


_IMPORTS_SQL = "i AS (SELECT c_nationkey AS project, ['express', 'nest', 'pg', 'lodash', '.', 'mongoose'][CAST((c_custkey * (c_nationkey + 1)) % 6 AS INTEGER) + 1] AS package FROM customer)"


def project_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gates(_imports(spark, sf_dir), ["project"]).select("project", F.array_join("frameworks", ",").alias("frameworks"), "web", "database")


GATES_SQL = f"""WITH {_IMPORTS_SQL} SELECT project, coalesce(string_agg(DISTINCT CASE WHEN package NOT IN ('lodash', '.') THEN package END, ',' ORDER BY CASE WHEN package NOT IN ('lodash', '.') THEN package END), '') AS frameworks,
bool_or(package IN ('express', 'nest')) AS web, bool_or(package NOT IN ('lodash', '.')) AS "database" FROM i GROUP BY project"""


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, functions = F.array(*map(F.lit, ["router", "app", "store"])), F.array(*map(F.lit, ["get", "use", "save", "Router"]))
    calls = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project")), "o_custkey")
    calls = calls.select("project", F.element_at(objects, (F.col("o_orderkey") % 3).cast("int") + 1).alias("object"), F.element_at(functions, (F.col("o_custkey") % 4).cast("int") + 1).alias("function"))
    left = R.without_noise(calls, R.gates(_imports(spark, sf_dir), ["project"]), ["project"])
    return left.groupBy("project", "object", "function").agg(F.count("*").alias("n"))


NOISE_SQL = f"""WITH {_IMPORTS_SQL}, x AS (SELECT project, bool_or(package = 'express') AS express FROM i GROUP BY project),
c AS (SELECT c_nationkey AS project, ['router', 'app', 'store'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS object, ['get', 'use', 'save', 'Router'][CAST(o_custkey % 4 AS INTEGER) + 1] AS function FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT project, object, function, count(*) AS n FROM c LEFT JOIN x USING (project) WHERE NOT (coalesce(express, false) AND object IN ('router', 'app') AND function IN ('get', 'use', 'Router')) GROUP BY ALL"""

_DIRS, _ENDS = ["src", "node_modules/x", "docs", "lib/build", "test"], [".js", ".py", ".ts", ".JSX", ".md"]


def watched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names)).cast("int") + 1)
    path = F.concat(at(_DIRS, "p_size"), F.lit("/"), F.col("p_partkey").cast("string"), at(_ENDS, "p_partkey"))
    return table(spark, sf_dir, "part").select(path.alias("path")).where(R.is_watched(F.col("path")))


WATCHED_SQL = """SELECT ['src', 'node_modules/x', 'docs', 'lib/build', 'test'][p_size % 5 + 1] || '/' || p_partkey || ['.js', '.py', '.ts', '.JSX', '.md'][CAST(p_partkey % 5 AS INTEGER) + 1] AS path
FROM part WHERE p_size % 5 IN (0, 4) AND p_partkey % 5 IN (0, 1, 3)"""


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    whole = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return S.benchmark_summary(lines.select(whole("l_discount").alias("edit_recall"), whole("l_tax").alias("edit_precision"), F.col("l_linenumber").alias("context_efficiency"), (F.col("l_partkey") % 7).alias("hallucination_rate"), (F.col("l_returnflag") == "R").cast("int").alias("test_pass_rate"), F.col("l_suppkey").alias("cost_usd"), whole("l_quantity").alias("latency_seconds")))


SUMMARY_SQL = """SELECT round(avg(CAST(round(l_discount * 100) AS BIGINT)), 4) AS avg_recall, round(avg(CAST(round(l_tax * 100) AS BIGINT)), 4) AS avg_precision, round(avg(l_linenumber), 2) AS avg_context_efficiency,
round(avg(l_partkey % 7), 2) AS avg_hallucination_rate, round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 4) AS test_pass_rate, CAST(sum(l_suppkey) AS BIGINT) AS total_cost_usd, round(avg(CAST(round(l_quantity * 100) AS BIGINT)), 2) AS avg_latency_seconds, count(*) AS tasks FROM lineitem"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the order graph; a node lies in the file of its kind and key modulo 50, suppliers in none."""
    file = lambda c: F.when(~F.col(c).startswith("supplier"), F.concat(F.split(c, ":")[0], F.lit("/"), (F.split(c, ":")[1].cast("bigint") % 50).cast("string")))
    return graph_edges(spark, sf_dir).select("src_key", "dst_key", "edge_type", file("src_key").alias("src_file"), file("dst_key").alias("dst_file"))


_FILES_SQL = edges_sql() + """, f AS (SELECT src_key, dst_key, edge_type, CASE WHEN src_key NOT LIKE 'supplier%' THEN split_part(src_key, ':', 1) || '/' || CAST(split_part(src_key, ':', 2) AS BIGINT) % 50 END AS src_file,
CASE WHEN dst_key NOT LIKE 'supplier%' THEN split_part(dst_key, ':', 1) || '/' || CAST(split_part(dst_key, ':', 2) AS BIGINT) % 50 END AS dst_file FROM edges)"""


def route_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From two files of customers, over calls and over imports between parts."""
    found = _files(spark, sf_dir)
    parts = F.col("p_partkey").cast("bigint")
    imports = table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("part/"), (parts % 50).cast("string")).alias("file"), F.concat(F.lit("lib/"), F.col("p_size").cast("string")).alias("resolved_file"))
    routes = spark.createDataFrame([(1, "customer/1"), (2, "part/7")], "seed_id int, file string")
    return G.route_core(found, imports, routes)


ROUTE_CORE_SQL = "WITH RECURSIVE " + _FILES_SQL.strip() + """, l AS (SELECT DISTINCT src_file AS s, dst_file AS d FROM f WHERE src_file IS NOT NULL AND dst_file IS NOT NULL UNION SELECT 'part/' || p_partkey % 50, 'lib/' || p_size FROM part WHERE p_size > 25),
w(seed_id, file) AS (SELECT 1, 'customer/1' UNION SELECT 2, 'part/7' UNION SELECT seed_id, d FROM w JOIN l ON l.s = w.file)
SELECT seed_id, file FROM w"""


def impacted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.impacted_files(_files(spark, sf_dir).withColumn("edge_type", F.lit("FUNCTION_CALL")), spark.createDataFrame([("part/3",), ("gone/1",)], "file string"))


IMPACTED_SQL = "WITH RECURSIVE " + _FILES_SQL.strip() + """, w(node) AS (SELECT dst_key FROM f WHERE dst_file = 'part/3' UNION SELECT src_key FROM w JOIN f ON f.dst_key = w.node)
SELECT 'part/3' AS file UNION SELECT 'gone/1' UNION SELECT src_file FROM f JOIN w ON src_key = node WHERE src_file IS NOT NULL"""


def relevant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over orders of one part only: components of a few nodes each."""
    found = _files(spark, sf_dir).where("edge_type = 'PLACED'")
    return G.relevant_files(found, spark.createDataFrame([("customer/5",)], "file string"), spark.createDataFrame([("new/file",)], "file string"))


RELEVANT_SQL = "WITH " + _FILES_SQL.strip() + """ SELECT 'customer/5' AS file UNION SELECT 'new/file' UNION SELECT dst_file FROM f WHERE edge_type = 'PLACED' AND src_file = 'customer/5'"""


def destructured_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as destructurings in their order, orders as uses of a name."""
    taken = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.concat(F.lit("n"), F.col("l_linenumber") % 2).alias("local"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("f"), F.col("l_partkey")).alias("function"), F.col("l_linenumber").alias("seq"))
    uses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.concat(F.lit("n"), F.col("o_custkey") % 3).alias("name"))
    return V.resolve_destructured(uses, taken.groupBy("file", "local", "seq").agg(F.min("source").alias("source"), F.min("function").alias("function")))


DESTRUCTURED_SQL = """WITH t AS (SELECT l_orderkey AS file, 'n' || l_linenumber % 2 AS name, l_linenumber AS seq, min('s' || l_suppkey) AS source, min('f' || l_partkey) AS function FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY seq DESC) AS n FROM t)
SELECT o_orderkey AS file, 'n' || o_custkey % 3 AS name, source AS source_object, function AS original FROM orders LEFT JOIN r ON r.file = o_orderkey AND r.name = 'n' || o_custkey % 3 AND n = 1"""


def static_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods of their type in the file of their brand; sizes over 25 are static."""
    defs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("class"), F.lit("m").alias("method"), (F.col("p_size") > 25).alias("static"), F.col("p_partkey").cast("int").alias("start_line"), F.col("p_partkey").alias("seq"))
    uses = defs.select("file", "class", "method").distinct().withColumn("want_static", F.explode(F.array(F.lit(True), F.lit(False))))
    return V.resolve_static(uses, defs)


STATIC_SQL = """WITH u AS (SELECT DISTINCT p_brand, p_type FROM part), w AS (SELECT true AS want UNION ALL SELECT false)
SELECT p_brand AS file, p_type AS class, 'm' AS method, want AS want_static, CAST(coalesce((SELECT min(p_partkey) FROM part x WHERE x.p_brand = u.p_brand AND x.p_type = u.p_type AND (x.p_size > 25) = want),
(SELECT min(p_partkey) FROM part x WHERE x.p_brand = u.p_brand AND x.p_type = u.p_type)) AS INTEGER) AS start_line FROM u, w"""


def callable_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files with functions; each order refers to one in one of five ways."""
    k, s = F.col("o_orderkey"), F.col("o_custkey") % 10
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    ref = F.coalesce(*[F.when(k % 5 == i, e) for i, e in enumerate([text("self.f", s), text("Cls.f", s), text("mod.f", s), text("f", s), F.concat(text("f", s), F.lit("()"))])])
    refs = table(spark, sf_dir, "orders").select(k.alias("ref_id"), text("file", F.col("o_custkey") % 5).alias("file"), F.when(k % 2 == 0, "Own").alias("class"), ref.alias("ref"))
    row = lambda names, rows: spark.createDataFrame(rows, names)
    methods = row("class string, name string, file string", [("Own", f"f{i}", "own") for i in range(0, 10, 2)] + [("Cls", f"f{i}", "cls") for i in range(0, 10, 3)])
    functions = row("file string, name string, kind string", [("file1", "f1", None), ("file2", "f2", "class"), ("lib", "f3", None), ("lib", "g4", None), ("star1", "f5", None), ("star2", "f5", None), ("mod", "f6", None)])
    imports = row("file string, local string, resolved_file string, exported string", [(f"file{i}", n, f, e) for i in range(5) for n, f, e in [("mod", "mod", None), ("f3", "lib", None), ("f4", "lib", "g4")]])
    stars = row("file string, source_file string, pos int", [(f"file{i}", f, p) for i in range(5) for f, p in [("star2", 1), ("star1", 0)]])
    return V.callable_targets(refs, methods, functions, imports, stars).select("ref_id", "target_file", "target_name", "target_class")


CALLABLE_SQL = """WITH r AS (SELECT o_orderkey AS ref_id, o_orderkey % 5 AS way, o_custkey % 10 AS s, 'file' || o_custkey % 5 AS file, o_orderkey % 2 = 0 AS own FROM orders),
t AS (SELECT *, CASE WHEN way = 0 AND own AND s % 2 = 0 THEN 'own' WHEN way = 1 AND s % 3 = 0 THEN 'cls' WHEN way = 2 AND s = 6 THEN 'mod' WHEN way = 3 AND s = 1 AND file = 'file1' THEN 'file1'
  WHEN way = 3 AND s IN (3, 4) THEN 'lib' WHEN way = 3 AND s = 5 THEN 'star1' END AS target_file FROM r)
SELECT ref_id, target_file, CASE WHEN target_file IS NOT NULL THEN CASE WHEN way = 3 AND s = 4 THEN 'g4' ELSE 'f' || s END END AS target_name, CASE target_file WHEN 'own' THEN 'Own' WHEN 'cls' THEN 'Cls' END AS target_class FROM t"""


def marker_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls of names that hold functions, classes or instances; customers' nations as functions, regions as classes."""
    kind = F.element_at(F.array(*map(F.lit, ["callable", "class", "instance"])), (F.col("o_orderkey") % 3).cast("int") + 1)
    nation = lambda n: F.concat(F.lit("n"), ((F.col("o_custkey") + n) % 30).cast("string"))
    region = lambda n: F.concat(F.lit("R"), ((F.col("o_custkey") + n) % 7).cast("string"))
    names = F.when(kind == "callable", F.array(nation(0), nation(1))).when(kind == "class", F.array(region(0), region(2))).otherwise(F.array(region(0)))
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), kind.alias("kind"), F.lit("a").alias("in_file"), names.alias("names"))
    nations = table(spark, sf_dir, "nation").select(F.lit("a").alias("file"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("name"), F.lit(None).cast("string").alias("class"))
    held = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("class"), F.concat(F.lit("file"), F.col("r_regionkey")).alias("file"))
    functions = nations.unionByName(held.where("class <> 'R2'").select("file", F.lit("__call__").alias("name"), "class"))
    return V.marker_calls(calls, functions, held)


MARKER_SQL = """WITH c AS (SELECT o_orderkey AS call_id, o_orderkey % 3 AS kind, o_custkey AS k FROM orders),
t AS (SELECT call_id, 'a' AS file, 'n' || n_nationkey AS name, NULL AS class, false AS constructor FROM c JOIN nation ON kind = 0 AND n_nationkey IN (k % 30, (k + 1) % 30)
  UNION ALL SELECT call_id, 'file' || r_regionkey, 'R' || r_regionkey, NULL, true FROM c JOIN region ON kind = 1 AND r_regionkey IN (k % 7, (k + 2) % 7)
  UNION ALL SELECT call_id, 'file' || r_regionkey, '__call__', 'R' || r_regionkey, false FROM c JOIN region ON kind = 2 AND r_regionkey = k % 7 AND r_regionkey <> 2)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY call_id) = 1 THEN 'typed' ELSE 'candidates' END AS resolution FROM t"""

QUERIES = {
    "split_call": split_call, "signatures": signatures, "numbered_views": numbered_views, "virtual_patches": virtual_patches, "target_tasks": target_tasks, "trusted_calls": trusted_calls, "project_gates": project_gates,
    "noise_filter": noise_filter, "watched_files": watched_files, "benchmark_summary": benchmark_summary, "route_core": route_core, "impacted_files": impacted_files, "relevant_files": relevant_files,
    "destructured_names": destructured_names, "static_methods": static_methods, "callable_targets": callable_targets, "marker_calls": marker_calls,
}
ORACLE = {
    "split_call": SPLIT_SQL, "signatures": SIGNATURES_SQL, "numbered_views": VIEWS_SQL, "virtual_patches": PATCHES_SQL, "target_tasks": TASKS_SQL, "trusted_calls": TRUSTED_SQL, "project_gates": GATES_SQL,
    "noise_filter": NOISE_SQL, "watched_files": WATCHED_SQL, "benchmark_summary": SUMMARY_SQL, "route_core": ROUTE_CORE_SQL, "impacted_files": IMPACTED_SQL, "relevant_files": RELEVANT_SQL,
    "destructured_names": DESTRUCTURED_SQL, "static_methods": STATIC_SQL, "callable_targets": CALLABLE_SQL, "marker_calls": MARKER_SQL,
}
