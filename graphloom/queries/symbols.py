"""Queries of the symbol family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import subwords, tokens
from ..operators import symbols as Y
from ..session import table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions: brand is the file, type the class."""
    return table(spark, sf_dir, "part").select(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.lower("p_type"), F.lit(".py")).alias("file"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.initcap("p_type").alias("class"), F.col("p_partkey").cast("int").alias("start_line"))


PARTS_SQL = "f AS (SELECT lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '.py' AS file, replace(p_name, ' ', '_') AS name, upper(p_type[1]) || lower(p_type[2:]) AS class, CAST(p_partkey AS INTEGER) AS start_line FROM part)"


def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.symbol_index(_parts(spark, sf_dir))


INDEX_SQL = f"WITH {PARTS_SQL} SELECT name AS symbol, file FROM f UNION SELECT class || '.' || name, file FROM f UNION SELECT class, file FROM f"

ASKED = "fix the small ring of economy"


def find_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.find_symbols(_parts(spark, sf_dir), ASKED, limit=25).select("file", "score")


FIND_SQL = f"""WITH {PARTS_SQL}, n AS (SELECT DISTINCT file, name, class FROM f),
s AS (SELECT *, list_distinct(list_filter(string_split(name, '_'), lambda x: length(x) >= 3)) AS subs FROM n),
t AS (SELECT count(*) AS total FROM n), d AS (SELECT word, count(*) AS df FROM (SELECT file, name, class, unnest(list_distinct(list_concat([name], subs))) AS word FROM s) GROUP BY word),
q AS (SELECT word, greatest(0.15, 1 - ln(1 + df) / ln(1 + total)) AS idf FROM d, t WHERE word IN ('fix', 'small', 'ring', 'economy')),
c AS (SELECT file, 'symbol' AS kind, 6 * greatest(0.25, coalesce(idf, 1.0)) AS points FROM (SELECT DISTINCT file, lower(class) AS low FROM s WHERE lower(class) IN ('fix', 'small', 'ring', 'economy')) LEFT JOIN q ON q.word = low),
u AS (SELECT file, 'sub' AS kind, 2 * sum(idf) AS points FROM (SELECT file, name, class, len(subs) AS n, unnest(list_filter(subs, lambda x: x IN ('fix', 'small', 'ring', 'economy'))) AS word FROM s) JOIN q USING (word)
      GROUP BY file, name, class, n HAVING count(*) >= 2 OR (n = 1 AND max(idf) > 0.6)),
b AS (SELECT DISTINCT file, 'name' AS kind, 3.0 AS points FROM s WHERE contains(regexp_extract(file, '([^/]+?)\\.[^./]*$', 1), 'small') OR contains(regexp_extract(file, '([^/]+?)\\.[^./]*$', 1), 'ring') OR contains(regexp_extract(file, '([^/]+?)\\.[^./]*$', 1), 'economy')),
e AS (SELECT * FROM c UNION ALL SELECT * FROM u UNION ALL SELECT * FROM b),
k AS (SELECT file, kind, least(sum(points), CASE kind WHEN 'symbol' THEN 30 WHEN 'sub' THEN 8 ELSE 3 END) AS points FROM e GROUP BY file, kind)
SELECT file, round(sum(points), 1) AS score FROM k GROUP BY file ORDER BY score DESC, file LIMIT 25"""


RANKED = "When is Small_Widget broken for the economy or large bolt in promo of tests"


def rank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols; their names and brands, written out, as literals."""
    parts = _parts(spark, sf_dir)
    literals = parts.select("file", F.concat(F.lit("the "), F.replace("name", F.lit("_"), F.lit(" ")), F.lit(" economy")).alias("text"))
    return Y.rank_files(parts, RANKED, literals, 40)


_RANKED_WORDS, _RANKED_PARTS = ("is", "small_widget", "broken", "economy", "or", "large", "bolt", "in", "promo", "of", "tests"), ("small", "widget", "broken", "economy", "large", "bolt", "promo", "tests")
_ARRAY = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
RANK_SQL = f"""WITH {PARTS_SQL}, p AS (SELECT file, name, class, list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(name, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), regexp_extract_all(class, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')), lambda x: lower(x)), lambda x: length(x) >= 3)) AS subs FROM f),
t AS (SELECT count(*) AS total FROM p), d AS (SELECT w.word, (SELECT count(*) FROM p WHERE list_contains(subs, w.word)) AS df FROM (SELECT DISTINCT unnest({_ARRAY(dict.fromkeys(_RANKED_WORDS + _RANKED_PARTS))}) AS word) w),
r AS (SELECT word, greatest(0.15, 1 - ln(1 + df) / ln(1 + total)) AS rare FROM d, t),
o AS (SELECT row_number() OVER () AS i, *, list_intersect(subs, {_ARRAY(_RANKED_PARTS)}) AS hit FROM p),
x AS (SELECT i, sum(rare) AS sum, max(rare) AS top FROM (SELECT i, unnest(hit) AS word FROM o) JOIN r USING (word) GROUP BY i),
e AS (SELECT file, 'symbol' AS kind, 10 * greatest(0.25, rare) AS points FROM o JOIN r ON word = lower(name) WHERE list_contains({_ARRAY(_RANKED_WORDS)}, lower(name))
  UNION ALL SELECT DISTINCT ON (file, class) file, 'symbol', 6 * greatest(0.25, rare) FROM o JOIN r ON word = lower(class) WHERE NOT list_contains({_ARRAY(_RANKED_WORDS)}, lower(name)) AND list_contains({_ARRAY(_RANKED_WORDS)}, lower(class))
  UNION ALL SELECT file, 'sub', 2 * sum FROM o JOIN x USING (i) WHERE NOT list_contains({_ARRAY(_RANKED_WORDS)}, lower(name)) AND NOT list_contains({_ARRAY(_RANKED_WORDS)}, lower(class)) AND (len(hit) >= 2 OR (len(hit) = 1 AND len(subs) = 1 AND top > 0.6))
  UNION ALL SELECT DISTINCT file, 'name', 3.0 FROM f WHERE len(list_filter({_ARRAY(w for w in _RANKED_WORDS if len(w) >= 4)}, lambda w: contains(split_part(file, '/', -1), w))) > 0
  UNION ALL SELECT file, 'litpart', 1.5 * n FROM (SELECT file, len(list_intersect(own, {_ARRAY(_RANKED_WORDS)})) AS n, len(own) AS m FROM (SELECT file, list_distinct(list_filter(regexp_extract_all(lower('the ' || replace(name, '_', ' ') || ' economy'), '[a-z_$][a-z0-9_$]*'), lambda w: length(w) >= 3 AND w <> 'the')) AS own FROM f)) WHERE n >= 2 AND n >= m * 0.5),
k AS (SELECT file, kind, least(sum(points), CASE kind WHEN 'symbol' THEN 30 WHEN 'sub' THEN 8 WHEN 'litpart' THEN 6 ELSE 3 END) AS points FROM e GROUP BY file, kind),
s AS (SELECT file, sum(points) AS sum FROM k GROUP BY file)
SELECT file, round(sum, 1) AS score FROM s ORDER BY round(sum, 9) DESC, file LIMIT 40"""


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return Y.skeleton(parts, parts.select("file"), 5)


SKELETON_SQL = f"""WITH {PARTS_SQL}, r AS (SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY start_line, name) AS INTEGER) AS nth, name, class, start_line, count(*) OVER (PARTITION BY file) > 5 AS truncated FROM f) SELECT * FROM r WHERE nth <= 5"""


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("word"))
    return Y.idf_table(docs, "word", "doc_id").select("word", "df", F.round("idf", 6).alias("idf"))


IDF_SQL = """WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents), t AS (SELECT count(DISTINCT doc_id) AS total FROM w)
SELECT word, count(DISTINCT doc_id) AS df, round(greatest(0.15, 1 - ln(1 + count(DISTINCT doc_id)) / ln(1 + any_value(total))), 6) AS idf FROM w, t GROUP BY word"""


def literals_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return Y.literals(lines).select(F.col("file").alias("doc_id"), "text", "nth")


LITERALS_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT doc_id, text, min(pos) AS pos FROM l WHERE length(text) BETWEEN 4 AND 120 AND NOT regexp_matches(text, '^[./~]|^[A-Za-z]+://') AND (contains(text, ' ') OR NOT regexp_matches(text, '^[A-Za-z0-9_$]+$')) GROUP BY doc_id, text)
SELECT doc_id, text, nth FROM (SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS nth FROM f) WHERE nth <= 200"""


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[tokens(F.col("text"), e).alias(e) for e in ("default", "gemini", "llama")])


TOKENS_SQL = """SELECT conv_id, turn, CAST(floor(length(text) / 4.0) AS BIGINT) AS "default", CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.75)) END AS BIGINT) AS gemini,
CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.25)) END AS BIGINT) AS llama FROM conversations"""


def subword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(subwords(F.concat_ws("_", "p_type", "p_name", "p_brand")), ",").alias("parts"))


SUBWORDS_SQL = "SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_extract_all(p_type || '_' || p_name || '_' || p_brand, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 3), ',') AS parts FROM part"

QUERIES = {"symbol_index": symbol_index, "find_symbols": find_symbols, "rank_files": rank_files, "skeleton": skeleton, "idf_table": idf_table, "literals_topn": literals_topn, "token_estimates": token_estimates, "subwords": subword_table}
ORACLE = {"symbol_index": INDEX_SQL, "find_symbols": FIND_SQL, "rank_files": RANK_SQL, "skeleton": SKELETON_SQL, "idf_table": IDF_SQL, "literals_topn": LITERALS_SQL, "token_estimates": TOKENS_SQL, "subwords": SUBWORDS_SQL}
