"""Queries over graphs built from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import impact as I
from ..plans.closure import label_components, reach
from ..plans.nodes import node
from ..session import table
from .tpch_graph import edges, edges_sql, label_of


def _seed(spark: SparkSession, key: str) -> DataFrame:
    return spark.createDataFrame([(0, key)], "seed_id bigint, key string")


def _reach_query(start: str, direction: str, depth: int, min_confidence: str | None = None, include_tests: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = reach(edges(spark, sf_dir, min_confidence, include_tests), _seed(spark, start), direction, depth).where("depth > 0")
        return found.select(F.split("key", ":")[0].alias("node_type"), F.split("key", ":")[1].cast("bigint").alias("node_id"), "depth")

    near, far = ("dst_key", "src_key") if direction == "up" else ("src_key", "dst_key")
    rank = {None: 0, "resolved": 3, "observed": 4}[min_confidence]
    sql = f"""WITH RECURSIVE {edges_sql(include_tests)}, walk(key, depth) AS (
      SELECT '{start}', 0 UNION SELECT e.{far}, w.depth + 1 FROM walk w JOIN ranked e ON e.{near} = w.key WHERE w.depth < {depth} AND e.rank >= {rank})
    SELECT split_part(key, ':', 1) AS node_type, CAST(split_part(key, ':', 2) AS BIGINT) AS node_id, CAST(min(depth) AS INTEGER) AS depth
    FROM walk GROUP BY key HAVING min(depth) > 0"""
    return run, sql


def _order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An execution graph with node structs: route (nation) -> function (customer) -> function (order) -> database (status).

    Functions live in files `c<nation>` and `o<status>`; orders of low priority count as test calls.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cust = lambda k, n: node("FUNCTION", file=F.concat(F.lit("c"), F.col(n).cast("string")), function=F.concat(F.lit("cust"), F.col(k).cast("string")))
    order = node("FUNCTION", file=F.concat(F.lit("o"), F.col("o_orderstatus")), function=F.concat(F.lit("order"), F.col("o_orderkey").cast("string")))
    common = [F.lit(None).cast("boolean").alias("observed"), F.lit(None).cast("string").alias("source")]
    routes = customer.select(F.lit("ROUTE_CALL").alias("edge_type"), node("ROUTE", route=F.concat(F.lit("/n"), F.col("c_nationkey").cast("string")), method="GET").alias("src"), cust("c_custkey", "c_nationkey").alias("dst"), F.lit(False).alias("is_test"), F.lit("resolved").alias("confidence"), *common)
    both = orders.join(customer, orders.o_custkey == customer.c_custkey)
    calls = both.select(F.lit("FUNCTION_CALL").alias("edge_type"), cust("c_custkey", "c_nationkey").alias("src"), order.alias("dst"), (F.col("o_orderpriority") == "5-LOW").alias("is_test"), label_of(F.col("o_orderpriority")).alias("confidence"), *common)
    db = orders.select(F.lit("DB_ACCESS").alias("edge_type"), order.alias("src"), node("DATABASE", model=F.col("o_orderstatus")).alias("dst"), F.lit(False).alias("is_test"), F.lit("resolved").alias("confidence"), *common)
    return routes.unionByName(calls).unionByName(db).withColumn("edge_id", F.xxhash64("edge_type", "src", "dst"))


ORDER_SQL = """
g AS (
  SELECT 'ROUTE_CALL' AS edge_type, 'ROUTE /n' || c_nationkey AS src, 'cust' || c_custkey AS dst, false AS is_test, 3 AS rank FROM customer
  UNION ALL SELECT 'FUNCTION_CALL', 'cust' || o_custkey, 'order' || o_orderkey, o_orderpriority = '5-LOW',
    CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '5-LOW' THEN 1 ELSE 2 END FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'DB_ACCESS', 'order' || o_orderkey, 'DB ' || o_orderstatus, false, 3 FROM orders)
"""

def _target(spark: SparkSession, sf_dir: str, key: int = 1) -> DataFrame:
    """The function of one order."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") == key)
    return orders.select(F.lit(0).cast("bigint").alias("seed_id"), node("FUNCTION", file=F.concat(F.lit("o"), F.col("o_orderstatus")), function=F.concat(F.lit("order"), F.col("o_orderkey").cast("string"))).alias("node"))


def _named(df: DataFrame) -> DataFrame:
    src = F.coalesce(F.col("src.function"), F.concat(F.lit("ROUTE "), F.col("src.route")))
    dst = F.coalesce(F.col("dst.function"), F.concat(F.lit("DB "), F.col("dst.model")))
    return df.select("direction", "depth", "edge_type", src.alias("src"), dst.alias("dst"))


def policy(name: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _named(I.resolve_impact(_order_graph(spark, sf_dir), _target(spark, sf_dir), name, **options))

    return run


UP = "SELECT 'up' AS direction, CAST(min(depth) AS INTEGER) AS depth, edge_type, src, dst FROM u GROUP BY edge_type, src, dst"
DOWN = "SELECT 'down' AS direction, CAST(min(depth) AS INTEGER) AS depth, edge_type, src, dst FROM d GROUP BY edge_type, src, dst"


def _policy_sql(where: str, depth: int, down: bool) -> str:
    d = f", d AS (SELECT 1 AS depth, g.* FROM g WHERE src = 'order1' AND {where} UNION SELECT d.depth + 1, g.* FROM d JOIN g ON g.src = d.dst WHERE d.depth < {depth} AND g.{where})" if down else ""
    return f"WITH RECURSIVE {ORDER_SQL}, u AS (SELECT 1 AS depth, g.* FROM g WHERE dst = 'order1' AND {where} UNION SELECT u.depth + 1, g.* FROM u JOIN g ON g.dst = u.src WHERE u.depth < {depth} AND g.{where}){d} {UP}" + (f" UNION ALL {DOWN}" if down else "")


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").where("c_custkey = 7")
    target = customer.select(F.lit(0).cast("bigint").alias("seed_id"), node("FUNCTION", file=F.concat(F.lit("c"), F.col("c_nationkey").cast("string")), function=F.lit("cust7")).alias("node"))
    return I.neighbors(_order_graph(spark, sf_dir), target, 2, include_tests=True).select("file", "function", "relation", "depth")


NEIGHBORS_SQL = """SELECT 'o' || o_orderstatus AS file, 'order' || o_orderkey AS function, 'callee' AS relation, CAST(1 AS INTEGER) AS depth
FROM orders WHERE o_custkey = 7 ORDER BY file, function LIMIT 40"""


def tests_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of an order's function that live in test files (here: files of even nations)."""
    graph = _order_graph(spark, sf_dir)
    files = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("file"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seed_id"), node("FUNCTION", file=F.concat(F.lit("o"), F.col("o_orderstatus")), function=F.concat(F.lit("order"), F.col("o_orderkey").cast("string"))).alias("node"))
    return I.tests_for(graph, targets, files, 3, limit=None).select(F.col("seed_id").alias("target"), "file", "function", "depth")


TESTS_SQL = """SELECT o_orderkey AS target, 'c' || c_nationkey AS file, 'cust' || c_custkey AS function, CAST(1 AS INTEGER) AS depth
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 2 = 0"""


def file_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: a page imports the page whose number its url's last number names, if there is one."""
    pages = table(spark, sf_dir, "pages")
    n = F.try_to_number(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("999999")).cast("bigint")
    links = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file"), F.concat(F.lit("p"), (n % 100).cast("string")).alias("resolved_file"), F.contains("url", F.lit("/fr/")).alias("is_test"))
    known = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("resolved_file"))
    links = links.join(known, "resolved_file", "left_semi").where("file <> resolved_file")
    return I.file_dependents(links, known.select(F.col("resolved_file").alias("file")), 3, limit=None).select(F.col("seed_id").alias("target"), "file", "depth", "is_test", "total")


DEPENDENTS_SQL = """WITH RECURSIVE l AS (
  SELECT 'p' || page_id AS file, 'p' || (CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) % 100) AS target, contains(url, '/fr/') AS is_test
  FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) <> ''),
k AS (SELECT * FROM l WHERE file <> target AND target IN (SELECT 'p' || page_id FROM pages)),
w(seed, key, depth) AS (SELECT 'p' || page_id, 'p' || page_id, 0 FROM pages UNION SELECT w.seed, k.file, w.depth + 1 FROM w JOIN k ON k.target = w.key WHERE w.depth < 3),
m AS (SELECT seed, key, min(depth) AS depth FROM w WHERE key <> seed GROUP BY seed, key),
t AS (SELECT file, bool_or(is_test) AS is_test FROM k GROUP BY file)
SELECT m.seed AS target, m.key AS file, CAST(m.depth AS INTEGER) AS depth, coalesce(t.is_test, false) AS is_test, count(*) OVER (PARTITION BY m.seed, coalesce(t.is_test, false)) AS total
FROM m LEFT JOIN t ON t.file = m.key"""


def routes_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.routes_by_model(_order_graph(spark, sf_dir), "F").groupBy("src.route").agg(F.min("depth").alias("depth"))


ROUTES_SQL = "SELECT '/n' || c_nationkey AS route, CAST(3 AS INTEGER) AS depth FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_nationkey"


def connected_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts tied by orders of at most two lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    few = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).where("n = 2")
    return label_components(few.select("a", "b")).select(F.col("node").alias("part"), "component")


COMPONENT_SQL = """WITH RECURSIVE p AS (SELECT min(l_partkey) AS a, max(l_partkey) AS b FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey HAVING count(*) = 2),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, w.label FROM w JOIN e ON e.a = w.node AND e.b > w.label)
SELECT node AS part, min(label) AS component FROM w GROUP BY node"""


def _taint_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user, in order, as functions that call the next: source `signup`, sink `purchase`."""
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events")
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return ev.select("event_id", "event_type", "user_id", nxt.alias("next_id"))


def multi_source_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within reach of each signup, over the next events of the same user as long as these are signups or clicks."""
    ev = _taint_graph(spark, sf_dir)
    fn = lambda c: node("FUNCTION", file="e", function=F.col(c).cast("string"))
    calls = ev.where("next_id is not null and event_type in ('signup', 'click')").select(F.lit("FUNCTION_CALL").alias("edge_type"), fn("event_id").alias("src"), fn("next_id").alias("dst"), F.col("event_id").alias("edge_id"))
    found = I.taint_findings(calls, ev.where("event_type = 'signup'").select(F.col("event_id").alias("seed_id"), fn("event_id").alias("node")), ev.where("event_type = 'purchase'").select(F.col("event_id").alias("sink_id"), fn("event_id").alias("node")))
    return found.select(F.col("seed_id").alias("source_id"), "sink_id", "depth", "type", "severity")


TAINT_SQL = """WITH RECURSIVE e AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events),
w(seed, key, depth) AS (SELECT event_id, event_id, 0 FROM e WHERE event_type = 'signup' UNION SELECT w.seed, e.next_id, w.depth + 1 FROM w JOIN e ON e.event_id = w.key AND e.event_type IN ('signup', 'click') AND e.next_id IS NOT NULL)
SELECT seed AS source_id, event_id AS sink_id, CAST(min(depth) AS INTEGER) AS depth, 'TAINT_FLOW' AS type, 'HIGH' AS severity FROM w JOIN e ON e.event_id = w.key AND e.event_type = 'purchase' GROUP BY seed, event_id"""


def vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint joined with database writes by the function's name alone (here: the user), in the reference's name-only mode."""
    ev = table(spark, sf_dir, "events")
    sources = ev.where("event_type = 'signup'").select(F.col("user_id").alias("function"), F.col("event_id").alias("source")).groupBy("function").agg(F.min("source").alias("source"))
    sinks = ev.where("event_type = 'purchase' and value > 90").select(F.col("user_id").alias("function"), F.col("event_id").alias("sink"))
    return sources.join(sinks, "function").select(F.lit("TAINTED_DB_ACCESS").alias("type"), "function", "source", "sink")


VULNERABLE_SQL = """SELECT 'TAINTED_DB_ACCESS' AS type, s.user_id AS function, s.source, p.event_id AS sink
FROM (SELECT user_id, min(event_id) AS source FROM events WHERE event_type = 'signup' GROUP BY user_id) s JOIN events p ON p.user_id = s.user_id WHERE p.event_type = 'purchase' AND p.value > 90"""


def sanitizer_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose function has no sanitizer (here: an error event of a value above 99)."""
    clean = table(spark, sf_dir, "events").where("event_type = 'error' and value > 99").select(F.col("user_id").alias("function")).distinct()
    return vulnerabilities(spark, sf_dir).join(clean, "function", "left_anti")


SANITIZER_SQL = f"SELECT * FROM ({VULNERABLE_SQL}) WHERE function NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 99)"


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    known = supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit("s").alias("resolved_file"))
    calls = lines.join(F.broadcast(known) if known.count() < 100_000 else known, "l_suppkey", "left").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), F.col("l_partkey").cast("string").alias("function"), "resolved_file", (F.col("l_returnflag") == "R").alias("external"))
    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed_id"), F.col("p_partkey").cast("string").alias("name"))
    found = I.completeness(calls, targets)
    return found.select(F.col("seed_id").alias("part"), "unresolved", "external", F.array_join("examples", ",").alias("examples"), "verdict")


COMPLETENESS_SQL = """WITH c AS (SELECT 'o' || l_orderkey AS file, l_partkey AS part, s_suppkey IS NOT NULL AS resolved, l_returnflag = 'R' AS ext FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey),
a AS (SELECT part, count(*) FILTER (WHERE NOT resolved AND NOT ext) AS unresolved, count(*) FILTER (WHERE ext) AS external,
      array_to_string(list_slice(list_sort(list_distinct(list(file) FILTER (WHERE NOT resolved AND NOT ext))), 1, 10), ',') AS examples FROM c GROUP BY part)
SELECT p_partkey AS part, coalesce(unresolved, 0) AS unresolved, coalesce(external, 0) AS external, coalesce(examples, '') AS examples,
  CASE WHEN coalesce(unresolved, 0) > 0 THEN 'unknown' WHEN coalesce(external, 0) > 0 THEN 'partial' ELSE 'complete' END AS verdict FROM part LEFT JOIN a ON a.part = p_partkey"""


def edge_confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.confidence_histogram(_order_graph(spark, sf_dir))


HISTOGRAM_SQL = """SELECT confidence, count(*) AS n, CAST(CASE confidence WHEN 'observed' THEN 4 WHEN 'resolved' THEN 3 WHEN 'unobserved' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'observed' WHEN '2-HIGH' THEN 'resolved' WHEN '3-MEDIUM' THEN 'candidates' WHEN '4-NOT SPECIFIED' THEN 'dispatch' ELSE 'unobserved' END AS confidence FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'resolved' FROM customer UNION ALL SELECT 'resolved' FROM orders) GROUP BY confidence"""


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return I.graph_metrics(functions=t("part"), calls=t("lineitem"), routes=t("nation"), execution_edges=t("orders"), taint_sources=t("events").where("event_type = 'signup'"))


METRICS_SQL = """SELECT 'functions' AS section, count(*) AS n FROM part UNION ALL SELECT 'calls', count(*) FROM lineitem UNION ALL SELECT 'routes', count(*) FROM nation
UNION ALL SELECT 'execution_edges', count(*) FROM orders UNION ALL SELECT 'taint_sources', count(*) FROM events WHERE event_type = 'signup'"""

NEW_FEATURE_SQL = f"""WITH {ORDER_SQL}, r AS (SELECT 'ROUTE /n' || c_nationkey AS route FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 1),
a AS (SELECT g.*, 1 AS depth FROM g JOIN r ON g.src = r.route), b AS (SELECT g.*, 2 AS depth FROM g WHERE edge_type = 'FUNCTION_CALL' AND src IN (SELECT dst FROM a)),
c AS (SELECT g.*, 3 AS depth FROM g WHERE edge_type = 'DB_ACCESS' AND src IN (SELECT dst FROM b))
SELECT 'down' AS direction, CAST(depth AS INTEGER) AS depth, edge_type, src, dst FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)"""

_UP, _DOWN, _SURE = _reach_query("supplier:1", "up", 3), _reach_query("customer:1", "down", 3), _reach_query("supplier:1", "up", 3, "resolved", include_tests=False)

QUERIES = {
    "impact_upstream": _UP[0], "impact_downstream": _DOWN[0], "impact_min_confidence": _SURE[0],
    "policy_default": policy("DEFAULT", include_tests=True), "policy_signature_change": policy("SIGNATURE_CHANGE", include_tests=True), "policy_local_edit": policy("LOCAL_EDIT"),
    "policy_dependency_only": policy("DEPENDENCY_ONLY", types=("DB_ACCESS", "FUNCTION_CALL"), include_tests=True), "policy_taint_flow": policy("TAINT_FLOW", include_tests=True), "policy_new_feature": policy("NEW_FEATURE"),
    "neighbors": neighbors, "tests_for": tests_for, "file_dependents": file_dependents, "routes_by_model": routes_by_model, "connected_component": connected_component,
    "multi_source_taint": multi_source_taint, "vulnerabilities": vulnerabilities, "sanitizer_antijoin": sanitizer_antijoin, "completeness": completeness,
    "edge_confidence_histogram": edge_confidence_histogram, "graph_metrics": graph_metrics,
}
ORACLE = {
    "impact_upstream": _UP[1], "impact_downstream": _DOWN[1], "impact_min_confidence": _SURE[1],
    "policy_default": _policy_sql("edge_type <> ''", 9, True), "policy_signature_change": _policy_sql("edge_type <> ''", 1, False), "policy_local_edit": _policy_sql("edge_type = ''", 1, False),
    "policy_dependency_only": _policy_sql("edge_type IN ('DB_ACCESS', 'FUNCTION_CALL')", 1, True), "policy_taint_flow": _policy_sql("edge_type IN ('FUNCTION_CALL', 'DB_ACCESS')", 9, True), "policy_new_feature": NEW_FEATURE_SQL,
    "neighbors": NEIGHBORS_SQL, "tests_for": TESTS_SQL, "file_dependents": DEPENDENTS_SQL, "routes_by_model": ROUTES_SQL, "connected_component": COMPONENT_SQL,
    "multi_source_taint": TAINT_SQL, "vulnerabilities": VULNERABLE_SQL, "sanitizer_antijoin": SANITIZER_SQL, "completeness": COMPLETENESS_SQL,
    "edge_confidence_histogram": HISTOGRAM_SQL, "graph_metrics": METRICS_SQL,
}
