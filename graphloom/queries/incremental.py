"""Queries of the incremental family over two snapshots of all documents: rows were added, deleted and edited between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import incremental as N
from ..session import table


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of all documents: one lacks the odd multiples of seven, the other the multiples of five and has its multiples of three edited."""
    docs = table(spark, sf_dir, "documents")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias("sha256")
    old = docs.where("not (doc_id % 7 = 0 and doc_id % 2 = 1)").select(F.col("doc_id").alias("file"), sha(F.col("text")), "lang", "source")
    new = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("file"), sha(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "!").otherwise(""))), "lang", "source")
    return old, new


SNAPSHOT_SQL = """o AS (SELECT doc_id AS file, sha256(text) AS h, lang, source FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 2 = 1)), n AS (SELECT doc_id AS file, sha256(text || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END) AS h, lang, source FROM documents WHERE doc_id % 5 <> 0)"""


def hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.hash_diff(*_snapshots(spark, sf_dir))


HASH_SQL = f"WITH {SNAPSHOT_SQL} SELECT coalesce(n.file, o.file) AS file, CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n ON n.file = o.file WHERE o.h IS DISTINCT FROM n.h"


def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    old = ev.where("event_id % 3 <> 0").select("user_id", "event_type", F.floor(F.col("value")).cast("bigint").alias("v"))
    new = ev.where("event_id % 4 <> 0").select("user_id", "event_type", F.floor(F.col("value")).cast("bigint").alias("v"))
    return N.graph_diff(old, new, ["user_id", "event_type", "v"])


DIFF_SQL = """WITH o AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_id % 3 <> 0), n AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_id % 4 <> 0)
SELECT *, 'new' AS change FROM n ANTI JOIN o USING (user_id, event_type, v) UNION ALL SELECT *, 'removed' FROM o ANTI JOIN n USING (user_id, event_type, v)"""


def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the table after an update differs from the one built afresh: nothing, both ways."""
    old, new = _snapshots(spark, sf_dir)
    updated = N.apply_update(old, new, N.hash_diff(old, new))
    ways = updated.exceptAll(new).agg(F.count("*").alias("n")).withColumn("way", F.lit("extra")).unionByName(new.exceptAll(updated).agg(F.count("*").alias("n")).withColumn("way", F.lit("missing")))
    return ways.unionByName(updated.agg(F.count("*").alias("n")).withColumn("way", F.lit("rows"))).select("way", "n")


EQUALS_SQL = "SELECT 'extra' AS way, 0::BIGINT AS n UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'rows', count(*) FROM documents WHERE doc_id % 5 <> 0"


def change_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    diff = N.graph_diff(old, new, ["file", "lang"])
    section = F.when(F.col("lang") == "en", "routes").when(F.col("lang") == "de", "database").otherwise("execution_edges")
    return N.classify_changes(diff.select(section.alias("section"), "change", F.col("file").cast("string").alias("name")))


CLASSIFY_SQL = f"""WITH {SNAPSHOT_SQL}, d AS (SELECT file, lang, 'new' AS change FROM n WHERE file NOT IN (SELECT file FROM o) UNION ALL SELECT file, lang, 'removed' FROM o WHERE file NOT IN (SELECT file FROM n)),
c AS (SELECT CASE lang WHEN 'en' THEN 'routes' WHEN 'de' THEN 'database' ELSE 'execution_edges' END AS section, change, CAST(file AS VARCHAR) AS name FROM d)
SELECT section, name, CASE WHEN section = 'routes' THEN CASE change WHEN 'new' THEN 'NEW_PUBLIC_API' ELSE 'BREAKING_API_CHANGE' END WHEN section = 'database' THEN 'DATABASE_CHANGE' ELSE 'NEW_EXECUTION_PATH' END AS type,
CASE WHEN section = 'database' OR (section = 'routes' AND change = 'removed') THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM c WHERE section = 'routes' OR change = 'new'"""


def _trace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Static edges: pairs of event types of users with an even id; the trace: consecutive events of all users, the user as the test."""
    ev = table(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = ev.select(F.concat("event_type", (F.col("user_id") % 20).cast("string")).alias("src"), nxt.alias("dst"), "user_id").where("dst is not null")
    trace = pairs.select("src", "dst", F.concat(F.lit("t"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("test"), F.lit(1).cast("bigint").alias("count"))
    static = pairs.select("src", F.lit("click").alias("dst")).distinct().unionByName(pairs.select("src", F.lit("never").alias("dst")).distinct()).withColumn("confidence", F.lit("candidates"))
    return static, trace


def trace_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    static, trace = _trace(spark, sf_dir)
    merged = N.merge_trace(static, trace, ["src", "dst"])
    return merged.select("src", "dst", "confidence", "static_confidence", "observed", "observed_count", F.array_join("observed_in", ",").alias("observed_in"))


TRACE_SQL = """WITH p AS (SELECT event_type || (user_id % 20) AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, 't' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS test FROM events),
t AS (SELECT src, dst, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(test))), 1, 5), ',') AS tests FROM p WHERE dst IS NOT NULL GROUP BY src, dst),
s AS (SELECT DISTINCT src, d AS dst FROM p, (VALUES ('click'), ('never')) v(d) WHERE dst IS NOT NULL)
SELECT coalesce(s.src, t.src) AS src, coalesce(s.dst, t.dst) AS dst, CASE WHEN n IS NOT NULL THEN 'observed' ELSE 'candidates' END AS confidence, CASE WHEN s.src IS NULL THEN 'trace-only' ELSE 'candidates' END AS static_confidence,
n IS NOT NULL AS observed, coalesce(n, 0) AS observed_count, coalesce(tests, '') AS observed_in FROM s FULL JOIN t ON s.src = t.src AND s.dst = t.dst"""


def fanout_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    static, trace = _trace(spark, sf_dir)
    merged = N.merge_trace(static, trace, ["src", "dst"]).withColumn("call_id", F.col("src"))
    return N.prune_fanout(merged).select("src", "dst", "confidence")


FANOUT_SQL = f"""WITH m AS ({TRACE_SQL}) SELECT src, dst, CASE WHEN NOT observed AND max(observed) OVER (PARTITION BY src) AND count(*) OVER (PARTITION BY src) > 1 THEN 'unobserved' ELSE confidence END AS confidence FROM m"""


def changed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of orders' lines as functions, lines with a discount over 0.09 as changed."""
    lines = table(spark, sf_dir, "lineitem")
    functions = lines.groupBy((F.col("l_orderkey") % 100).alias("file"), F.col("l_suppkey").alias("name")).agg(F.min("l_partkey").alias("start_line"), (F.min("l_partkey") + 5).alias("end_line"))
    changed = lines.where("l_discount > 0.09").select((F.col("l_orderkey") % 100).alias("file"), F.col("l_partkey").alias("line")).distinct()
    return N.changed_functions(functions, changed).select("file", "name", "start_line", "end_line")


CHANGED_SQL = """WITH f AS (SELECT l_orderkey % 100 AS file, l_suppkey AS name, min(l_partkey) AS start_line, min(l_partkey) + 5 AS end_line FROM lineitem GROUP BY ALL), c AS (SELECT DISTINCT l_orderkey % 100 AS file, l_partkey AS line FROM lineitem WHERE l_discount > 0.09)
SELECT DISTINCT f.* FROM f JOIN c ON c.file = f.file AND c.line BETWEEN f.start_line AND f.end_line"""

QUERIES = {"hash_diff": hash_diff, "graph_diff": graph_diff, "incremental_equals_full": incremental_equals_full, "change_classifier": change_classifier, "trace_merge": trace_merge, "fanout_demotion": fanout_demotion, "changed_functions": changed_functions}
ORACLE = {"hash_diff": HASH_SQL, "graph_diff": DIFF_SQL, "incremental_equals_full": EQUALS_SQL, "change_classifier": CLASSIFY_SQL, "trace_merge": TRACE_SQL, "fanout_demotion": FANOUT_SQL, "changed_functions": CHANGED_SQL}
