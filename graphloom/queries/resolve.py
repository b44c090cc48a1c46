"""Queries of the lookup family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import resolve as R
from ..plans.priority import enclosing, first_match, nearest_before
from ..session import table


def resolve_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the last signup of the user before it, else the first after."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    calls = ev.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    defs = ev.where("event_type = 'signup'").select("user_id", F.col("at").alias("def_at"), F.col("event_id").alias("def_id"))
    return nearest_before(calls, defs, ["user_id"], "at", "def_at", ["def_id"], "event_id").select("event_id", "def_id")


NEAREST_SQL = """WITH d AS (SELECT user_id, ts, event_id AS def_id FROM events WHERE event_type = 'signup'), c AS (SELECT * FROM events WHERE event_type = 'purchase'),
b AS (SELECT c.event_id, d.def_id FROM c ASOF LEFT JOIN d ON c.user_id = d.user_id AND c.ts >= d.ts), a AS (SELECT c.event_id, d.def_id FROM c ASOF LEFT JOIN d ON c.user_id = d.user_id AND c.ts < d.ts)
SELECT b.event_id, coalesce(b.def_id, a.def_id) AS def_id FROM b JOIN a USING (event_id)"""


def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of four tries (key, key + 1, key * 2, key / 2) that is a customer with a positive balance."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    good = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey")
    c = F.col("o_custkey")
    return first_match(orders, "o_orderkey", F.array(c, c + 1, c * 2, F.floor(c / 2).cast("bigint")), good, "c_custkey", "resolved").select("o_orderkey", "resolved")


PRIORITY_SQL = """WITH t AS (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1, o_custkey * 2, o_custkey // 2]) AS try, unnest([0, 1, 2, 3]) AS place FROM orders),
h AS (SELECT o_orderkey, arg_min(try, place) AS resolved FROM t JOIN customer ON c_custkey = try AND c_acctbal > 5000 GROUP BY o_orderkey) SELECT o_orderkey, resolved FROM orders LEFT JOIN h USING (o_orderkey)"""


def alias_scope_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names by region: an alias of the nation's own scope if its key is even, one of the region if it divides by three."""
    nation = table(spark, sf_dir, "nation")
    uses = nation.select(F.col("n_regionkey").alias("file"), F.col("n_name").alias("scope"), (F.col("n_nationkey") % 5).cast("string").alias("name"))
    own = nation.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("file"), F.col("n_name").alias("scope"), (F.col("n_nationkey") % 5).cast("string").alias("alias"), F.concat(F.lit("own"), F.col("n_nationkey").cast("string")).alias("original"))
    shared = nation.where("n_nationkey % 3 = 0").groupBy(F.col("n_regionkey").alias("file"), (F.col("n_nationkey") % 5).cast("string").alias("alias")).agg(F.min(F.concat(F.lit("all"), F.col("n_nationkey").cast("string"))).alias("original")).withColumn("scope", F.lit("GLOBAL"))
    return R.resolve_alias(uses, own.unionByName(shared))


ALIAS_SQL = """WITH s AS (SELECT n_regionkey AS file, CAST(n_nationkey % 5 AS VARCHAR) AS alias, min('all' || n_nationkey) AS original FROM nation WHERE n_nationkey % 3 = 0 GROUP BY ALL)
SELECT n_regionkey AS file, n_name AS scope, CAST(n_nationkey % 5 AS VARCHAR) AS name, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'own' || n_nationkey END, s.original, CAST(n_nationkey % 5 AS VARCHAR)) AS original
FROM nation LEFT JOIN s ON s.file = n_regionkey AND s.alias = CAST(n_nationkey % 5 AS VARCHAR)"""


def type_scope_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scopes whose parent is half their number; the market segment of the customer with that number is the type of `v` there."""
    part = table(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.col("p_partkey").cast("string").alias("scope"))
    parents = part.where("scope <> '0'").select("file", "scope", F.floor(F.col("scope").cast("bigint") / 2).cast("string").alias("parent"))
    types = table(spark, sf_dir, "customer").where("c_acctbal > 8000").select(F.lit("f").alias("file"), F.col("c_custkey").cast("string").alias("scope"), F.lit("v").alias("variable"), F.col("c_mktsegment").alias("type"))
    every = types.unionByName(spark.createDataFrame([("f", "GLOBAL", "v", "ANY")], types.schema))
    return R.resolve_type(part.withColumn("variable", F.lit("v")), every, parents, 12).select("scope", "type")


TYPE_SQL = """WITH RECURSIVE w(scope, a, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT scope, a // 2, depth + 1 FROM w WHERE a > 0 AND depth < 12),
h AS (SELECT scope, arg_min(c_mktsegment, depth) AS type FROM w JOIN customer ON c_custkey = a AND c_acctbal > 8000 GROUP BY scope)
SELECT CAST(p_partkey AS VARCHAR) AS scope, coalesce(type, 'ANY') AS type FROM part LEFT JOIN h ON scope = p_partkey"""


def arg_param_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as arguments: the first three places are positional parameters of the order's function, the rest one takes the others."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    args = lines.select(F.col("l_orderkey").alias("call_id"), F.lit("f").alias("function"), F.col("l_linenumber").alias("pos"), F.col("part").cast("string").alias("value"))
    params = spark.createDataFrame([("f", 1, "positional", "a", None), ("f", 2, "positional", "b", None), ("f", 3, "positional", "c", None), ("f", 4, "rest", "more", None)], "function string, pos int, group_type string, name string, keys array<string>")
    return R.argument_flow(args, params).select("call_id", "pos", "value", "parameter", "kind")


ARG_SQL = """SELECT l_orderkey AS call_id, l_linenumber AS pos, CAST(min(l_partkey) AS VARCHAR) AS value, CASE l_linenumber WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' ELSE 'more' END AS parameter,
CASE WHEN l_linenumber < 4 THEN 'positional' ELSE 'rest' END AS kind FROM lineitem WHERE l_linenumber >= 1 GROUP BY l_orderkey, l_linenumber"""


def route_template_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("call_id"), F.lit("get").alias("method"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    routes = spark.createDataFrame([(1, "GET", "/en/{id}"), (2, "ANY", "/{lang}/{id}"), (3, "POST", "/de/{id}"), (4, "GET", "/fr/**"), (5, "GET", "/es/*")], "route_id int, method string, template string")
    return R.route_matches(pages, routes).select("call_id", "route_id", "wildcards")


ROUTE_SQL = r"""WITH c AS (SELECT page_id AS call_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(route_id, pattern, wildcards) AS (VALUES (1, '^/en/[^/]+/?$', 1), (2, '^/[^/]+/[^/]+/?$', 2), (4, '^/fr/.*/?$', 2), (5, '^/es/[^/]+/?$', 1)),
m AS (SELECT call_id, route_id, wildcards, rank() OVER (PARTITION BY call_id ORDER BY wildcards) AS k FROM c JOIN r ON regexp_matches(path, pattern))
SELECT call_id, CAST(route_id AS INTEGER) AS route_id, CAST(wildcards AS INTEGER) AS wildcards FROM m WHERE k = 1"""


def owner_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest span between a user's signups, or between its errors, that an event of that user lies in."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    nxt = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    spans = ev.where("event_type in ('signup', 'error')").select("user_id", F.col("event_id").alias("owner"), F.col("ts").alias("s"), nxt.alias("e")).where("e is not null")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    points = ev.select("event_id", "user_id", micros("ts"))
    return enclosing(points, spans.select("user_id", "owner", micros("s"), micros("e")), ["user_id"], "ts", "ts", "s", "e", "event_id", ["owner"], width=6 * 3600 * 10**6).select("event_id", "owner")


OWNER_SQL = """WITH s AS (SELECT user_id, event_id AS owner, ts AS s, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS e FROM events WHERE event_type IN ('signup', 'error')),
h AS (SELECT v.event_id, arg_min(s.owner, (epoch_us(s.e) - epoch_us(s.s), epoch_us(s.s))) AS owner FROM events v JOIN s ON s.user_id = v.user_id AND s.s <= v.ts AND s.e >= v.ts WHERE s.e IS NOT NULL GROUP BY v.event_id)
SELECT event_id, owner FROM events LEFT JOIN h USING (event_id)"""


def fixpoint_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types known for ECONOMY parts flow between parts and suppliers along the order lines of small quantity, up to six rounds."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity < 3")
    p, s = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    both = lines.select(p.alias("p"), s.alias("s")).distinct()
    flows = both.select(F.col("p").alias("src"), F.col("s").alias("dst")).unionByName(both.select(F.col("s").alias("src"), F.col("p").alias("dst")))
    known = part.where("p_type = 'ECONOMY' and p_size > 45").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item"), F.col("p_brand").alias("type"))
    return R.propagate_types(known, flows, 6)


FIXPOINT_SQL = """WITH b AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem WHERE l_quantity < 3), f AS (SELECT p AS src, s AS dst FROM b UNION ALL SELECT s, p FROM b),
s0 AS (SELECT 'p' || p_partkey AS item, p_brand AS type, 0 AS round FROM part WHERE p_type = 'ECONOMY' AND p_size > 45)
""" + "".join(f""", s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT dst, min(type), {k} FROM f JOIN s{k - 1} ON item = src WHERE dst NOT IN (SELECT item FROM s{k - 1}) GROUP BY dst HAVING min(type) = max(type))
""" for k in range(1, 7)) + "SELECT item, type, CAST(round AS INTEGER) AS round FROM s6"

QUERIES = {"resolve_nearest": resolve_nearest, "resolve_priority": resolve_priority, "alias_scope_fallback": alias_scope_fallback, "type_scope_chain": type_scope_chain, "arg_param_flow": arg_param_flow, "route_template_theta": route_template_theta, "owner_scope": owner_scope, "fixpoint_inference": fixpoint_inference}
ORACLE = {"resolve_nearest": NEAREST_SQL, "resolve_priority": PRIORITY_SQL, "alias_scope_fallback": ALIAS_SQL, "type_scope_chain": TYPE_SQL, "arg_param_flow": ARG_SQL, "route_template_theta": ROUTE_SQL, "owner_scope": OWNER_SQL, "fixpoint_inference": FIXPOINT_SQL}
