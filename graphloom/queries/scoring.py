"""Queries of the scoring family: labels are the truth, simple rules over whole texts the selection; documents are patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring as S
from ..session import table


def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents of good quality against those of over 200 words."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    words = F.size(F.regexp_extract_all("text", F.lit("[^ \n]+"), 0))
    return S.recall_precision_by(docs, ["source"], F.col("quality") == 1, words > 200)


RECALL_SQL = r"""WITH d AS (SELECT source, doc_id, quality = 1 AS a, len(regexp_extract_all(text, '[^ \n]+')) > 200 AS s FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, count(*) FILTER (WHERE a AND s) AS tp, count(*) FILTER (WHERE a) AS n, count(*) FILTER (WHERE s) AS m FROM d GROUP BY source)
SELECT source, CAST(tp AS INTEGER) AS tp, CAST(m - tp AS INTEGER) AS fp, CAST(n - tp AS INTEGER) AS fn, CASE WHEN n = 0 THEN 1.0 ELSE round(tp / n, 4) END::DOUBLE AS recall, CASE WHEN m = 0 THEN 1.0 ELSE round(tp / m, 4) END::DOUBLE AS precision FROM c"""


def precision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language: whether a document of at least 1000 characters is of good quality; documents without a label are unknown."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return S.precision_audit(docs.select(F.col("lang").alias("kind"), F.when(F.length("text") >= 1000, 1).otherwise(0).alias("ours"), F.when(F.col("quality").isNotNull(), F.array("quality")).alias("oracle")))


AUDIT_SQL = """WITH s AS (SELECT lang AS kind, CASE WHEN length(text) >= 1000 THEN 1 ELSE 0 END AS ours, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN grouping(kind) = 1 THEN 'ALL' ELSE kind END AS kind, count(*) AS total, count(*) FILTER (WHERE quality IS NULL) AS unknown, count(quality) AS judged, count(*) FILTER (WHERE ours = quality) AS agree,
CASE WHEN count(quality) > 0 THEN round(count(*) FILTER (WHERE ours = quality) / count(quality), 4) END AS precision FROM s GROUP BY ROLLUP (kind)"""


def scoring_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By conversation: the user's text as the context of the whole, and what the tokens would cost."""
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("whole"), F.sum(F.when(F.col("role") == "user", F.length("text")).otherwise(0)).alias("context"))
    return talk.select("conv_id", S.efficiency(F.col("context"), F.col("whole")).alias("efficiency"), S.cost(F.floor(F.col("context") / 4), F.floor((F.col("whole") - F.col("context")) / 4), 0.25, 1.25).alias("usd"))


COST_SQL = """WITH t AS (SELECT conv_id, sum(length(text)) AS whole, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS context FROM conversations GROUP BY conv_id)
SELECT conv_id, round(greatest(0, least(100, (1 - context / whole) * 100)), 2) AS efficiency, round(floor(context / 4) * 0.25::DOUBLE / 1e6 + floor((whole - context) / 4) * 1.25::DOUBLE / 1e6, 6) AS usd FROM t"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return S.with_added(docs, "text").select("doc_id", "text", *[c.alias(n) for n, c in S.patch_features(F.col("added_lines"), F.col("added_text")).items()])


def patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    return f.select("doc_id", *[F.size(n).alias(n) for n in ("declared", "called", "members", "assigned", "identifiers")], "comments")


_SKIP = ", ".join(f"'{w}'" for w in S.KEYWORDS)
FEATURES_SQL = rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), p AS (SELECT doc_id, lines, list_filter(lines, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')) AS plus FROM l),
a AS (SELECT doc_id, CASE WHEN len(plus) > 0 THEN list_transform(plus, lambda x: x[2:]) ELSE lines END AS own FROM p), t AS (SELECT doc_id, own, array_to_string(own, chr(10)) AS text FROM a)
SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '\b(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1))) AS INTEGER) AS declared, CAST(len(list_distinct(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)\s*\(', 1))) AS INTEGER) AS called,
CAST(len(list_distinct(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*\.[A-Za-z_$][A-Za-z0-9_$]*)', 1))) AS INTEGER) AS members, CAST(len(list_distinct(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)\s*=[^=>]', 1))) AS INTEGER) AS assigned,
CAST(len(list_filter(list_distinct(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*)', 1)), lambda x: lower(x) NOT IN ({_SKIP}))) AS INTEGER) AS identifiers,
CAST(len(list_filter(own, lambda x: regexp_matches(ltrim(x), '^(//|#|/\*)'))) AS INTEGER) AS comments FROM t"""


def simulation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    score = S.simulation_score({"unknown_variable": F.size("assigned"), "unresolved_call": F.size("called"), "broken_return": F.when(F.contains("text", F.lit("|")), 1).otherwise(0)})
    return f.select("doc_id", score.alias("score"), (score >= S.SAFE).alias("safe"))


SIMULATION_SQL = f"""WITH f AS ({FEATURES_SQL}), s AS (SELECT doc_id, round(greatest(0.0, least(1.0, 1 - (assigned * 0.05::DOUBLE + called * 0.25::DOUBLE + CASE WHEN contains(text, '|') THEN 1 ELSE 0 END * 0.1::DOUBLE))), 4) AS score FROM f JOIN documents USING (doc_id)) SELECT doc_id, score, score >= 0.7 AS safe FROM s"""


def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    tainted = F.when(F.contains(F.lower("text"), F.lit("password")) | F.contains("text", F.lit("token =")), 1).otherwise(0)
    score = S.trust_score(F.col("called"), F.col("members"), F.array(F.lit("the"), F.lit("of"), F.lit("and")), tainted)
    return f.select("doc_id", score.alias("score"), (score >= S.SAFE).alias("trusted"))


_CALLED = r"list_distinct(regexp_extract_all(array_to_string(own, chr(10)), '([A-Za-z_$][A-Za-z0-9_$]*)\s*\(', 1))"
_MEMBERS = r"list_distinct(regexp_extract_all(array_to_string(own, chr(10)), '([A-Za-z_$][A-Za-z0-9_$]*\.[A-Za-z_$][A-Za-z0-9_$]*)', 1))"
TRUST_SQL = f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents), p AS (SELECT doc_id, text, lines, list_filter(lines, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')) AS plus FROM l),
a AS (SELECT doc_id, text, CASE WHEN len(plus) > 0 THEN list_transform(plus, lambda x: x[2:]) ELSE lines END AS own FROM p),
c AS (SELECT doc_id, text, {_CALLED} AS called, {_MEMBERS} AS members FROM a),
n AS (SELECT doc_id, len(list_filter(called, lambda x: x IN ('eval', 'exec', 'Function', 'child_process'))) + len(list_filter(members, lambda x: string_split(x, '.')[1] IN ('eval', 'exec', 'Function', 'child_process'))) AS bad,
  len(list_filter(called, lambda x: x NOT IN ('eval', 'exec', 'Function', 'child_process', 'the', 'of', 'and'))) AS odd, CASE WHEN contains(lower(text), 'password') OR contains(text, 'token =') THEN 1 ELSE 0 END AS tainted FROM c),
s AS (SELECT doc_id, round(greatest(0.0, least(1.0, 1 - (bad * 0.5::DOUBLE + odd * 0.2::DOUBLE + tainted * 0.4::DOUBLE))), 4) AS score FROM n) SELECT doc_id, score, score >= 0.7 AS trusted FROM s"""


def safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = trust_score(spark, sf_dir).select("doc_id", F.col("score").alias("t")).join(simulation_score(spark, sf_dir).select("doc_id", F.col("score").alias("s")), "doc_id")
    score, ok = S.safety(F.col("t"), F.col("s"))
    return both.select("doc_id", score.alias("score"), ok.alias("safe"))


SAFETY_SQL = f"SELECT t.doc_id, least(t.score, s.score) AS score, t.trusted AND s.safe AS safe FROM ({TRUST_SQL}) t JOIN ({SIMULATION_SQL}) s ON s.doc_id = t.doc_id"


def security_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("tag", S.security_tag(F.col("line"))).where("tag is not null").select("doc_id", "pos", "tag")


TAGS_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
t AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(lower(line), '\b(select|insert|update|delete)\b.*\b(from|into|set)\b') THEN 'RAW_SQL' WHEN regexp_matches(lower(line), 'passw|passwd|pwd') THEN 'PASSWORD_FLOW'
  WHEN regexp_matches(lower(line), 'token|jwt|secret') THEN 'TOKEN_USAGE' WHEN regexp_matches(lower(line), 'req\.(body|query|params)|input\(') THEN 'USER_INPUT' END AS tag FROM l) SELECT * FROM t WHERE tag IS NOT NULL"""

QUERIES = {"recall_precision": recall_precision, "precision_audit": precision_audit, "scoring_cost": scoring_cost, "patch_features": patch_features, "simulation_score": simulation_score, "trust_score": trust_score, "safety": safety, "security_tags": security_tags}
ORACLE = {"recall_precision": RECALL_SQL, "precision_audit": AUDIT_SQL, "scoring_cost": COST_SQL, "patch_features": FEATURES_SQL, "simulation_score": SIMULATION_SQL, "trust_score": TRUST_SQL, "safety": SAFETY_SQL, "security_tags": TAGS_SQL}
