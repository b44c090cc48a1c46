"""Queries of the telemetry family: conversations are transcripts whose user turns end a window, events are steps of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import telemetry as T
from ..session import table


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def task_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    return T.task_windows(talk, "conv_id", ["turn"], F.col("role") == "user").select("conv_id", "turn", "window_id")


WINDOWS_SQL = """SELECT conv_id, turn, CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS window_id FROM conversations"""


def lookahead_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    found = ev.withColumn("next_view", T.look_ahead(ev, "user_id", ["ts", "event_id"], F.col("event_type") == "view", F.col("event_id")))
    return found.where("event_type = 'click'").select("event_id", "next_view")


LOOK_SQL = """SELECT event_id, next_view FROM (SELECT *, first(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS next_view FROM events) WHERE event_type = 'click'"""


def duplicate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a user's events between purchases, on days: many share their bounds."""
    ev = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    windows = T.task_windows(ev, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    return T.window_bounds(windows, "user_id", "day").select("user_id", "window_id", "steps", "seconds", "zero_length", "duplicate")


BOUNDS_SQL = """WITH w AS (SELECT user_id, date_trunc('day', ts) AS day, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS window_id FROM events),
b AS (SELECT user_id, window_id, min(day) AS s, max(day) AS e, count(*) AS steps FROM w GROUP BY user_id, window_id)
SELECT user_id, window_id, steps, (epoch_us(e) - epoch_us(s)) / 1e6 AS seconds, s = e AS zero_length, count(*) OVER (PARTITION BY s, e) > 1 AS duplicate FROM b"""


def query_session_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error in the first session of its user that holds it; a session runs from a signup to the next."""
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _micros("ts").alias("at"))
    nxt = F.lead("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    sessions = ev.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("session_id"), F.col("at").alias("start"), nxt.alias("end")).where("end is not null")
    queries = ev.where("event_type = 'error'").select("event_id", "user_id", "at")
    return T.in_session(queries, sessions, ["user_id"], "event_id", "at").select("event_id", "session_id")


SESSION_SQL = """WITH s AS (SELECT user_id, event_id AS session_id, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events WHERE event_type = 'signup'),
h AS (SELECT q.event_id, arg_min(session_id, (epoch_us(s.s), session_id)) AS session_id FROM events q JOIN s ON s.user_id = q.user_id AND s.s <= q.ts AND q.ts <= s.e WHERE q.event_type = 'error' GROUP BY q.event_id)
SELECT event_id, session_id FROM events LEFT JOIN h USING (event_id) WHERE event_type = 'error'"""

def _kind():
    return F.when(F.col("role") == "user", "USER_INPUT").when(F.col("role") == "assistant", F.when(F.length("text") > 300, "VIEW_FILE").otherwise("PLANNER_RESPONSE")).otherwise("SYSTEM_MESSAGE")
KIND_SQL = "CASE role WHEN 'user' THEN 'user_tokens' WHEN 'assistant' THEN CASE WHEN length(text) > 300 THEN 'file_view_tokens' ELSE 'planner_tokens' END ELSE 'diagnostic_tokens' END"


def token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = T.task_windows(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role") == "user")
    found = T.attribution(windows, ["conv_id", "window_id"], _kind(), tokens(F.col("text")))
    return found.select("conv_id", "window_id", "user_tokens", "planner_tokens", "file_view_tokens", "diagnostic_tokens", "injected_tokens", "total_tokens")


ATTRIBUTION_SQL = f"""WITH w AS ({WINDOWS_SQL.replace("SELECT conv_id, turn,", f"SELECT conv_id, {KIND_SQL} AS c, CAST(floor(length(text) / 4.0) AS BIGINT) AS t,")})
SELECT conv_id, window_id, CAST(coalesce(sum(t) FILTER (WHERE c = 'user_tokens'), 0) AS BIGINT) AS user_tokens, CAST(coalesce(sum(t) FILTER (WHERE c = 'planner_tokens'), 0) AS BIGINT) AS planner_tokens,
CAST(coalesce(sum(t) FILTER (WHERE c = 'file_view_tokens'), 0) AS BIGINT) AS file_view_tokens, CAST(coalesce(sum(t) FILTER (WHERE c = 'diagnostic_tokens'), 0) AS BIGINT) AS diagnostic_tokens,
CAST(coalesce(sum(t) FILTER (WHERE c = 'file_view_tokens'), 0) AS BIGINT) AS injected_tokens, CAST(sum(t) AS BIGINT) AS total_tokens FROM w GROUP BY conv_id, window_id"""


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return T.session_summary(ev, "user_id", F.when(F.col("event_type").isin("view", "purchase"), k), F.col("event_type") == "purchase", F.floor(F.length("props") / 4), F.length("props"), F.when(k.cast("int") < 50, "repo").otherwise("external"))


SUMMARY_SQL = """WITH e AS (SELECT user_id, event_type, props, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, length(props) AS c, length(props) // 4 AS t FROM events),
p AS (SELECT user_id, CASE WHEN event_type IN ('view', 'purchase') THEN k END AS p, event_type, k, c, t FROM e), o AS (SELECT user_id, max(n) AS m FROM (SELECT user_id, p, count(*) AS n FROM p WHERE p IS NOT NULL GROUP BY ALL) GROUP BY user_id)
SELECT user_id, count(DISTINCT p) AS files_opened, count(DISTINCT CASE WHEN event_type = 'purchase' THEN p END) AS files_modified, CAST(sum(c) AS BIGINT) AS chars, CAST(sum(t) AS BIGINT) AS tokens,
CAST(sum(CASE WHEN CAST(k AS INTEGER) < 50 THEN t ELSE 0 END) AS BIGINT) AS repo_tokens, CAST(sum(CASE WHEN CAST(k AS INTEGER) < 50 THEN 0 ELSE t END) AS BIGINT) AS external_tokens, coalesce(max(m), 0) AS most_opened FROM p LEFT JOIN o USING (user_id) GROUP BY user_id"""


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    runs = talk.where("role in ('user', 'assistant')").select(F.col("conv_id").alias("task"), F.when(F.col("role") == "assistant", "baseline").otherwise("token_reducer").alias("mode"), tokens(F.col("text")).alias("total_tokens"), F.col("turn").cast("double").alias("seconds"))
    return T.compare_runs(runs)


COMPARE_SQL = """WITH b AS (SELECT conv_id AS task, CAST(sum(CASE WHEN role = 'assistant' THEN floor(length(text) / 4.0) END) AS BIGINT) AS baseline_tokens, CAST(sum(CASE WHEN role = 'user' THEN floor(length(text) / 4.0) END) AS BIGINT) AS reduced_tokens,
CAST(sum(CASE WHEN role = 'assistant' THEN turn END) AS DOUBLE) AS baseline_seconds, CAST(sum(CASE WHEN role = 'user' THEN turn END) AS DOUBLE) AS reduced_seconds FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
SELECT *, baseline_tokens - reduced_tokens AS saved, CASE WHEN baseline_tokens > 0 THEN round((1 - reduced_tokens / baseline_tokens) * 100, 2) ELSE 0.0 END AS percent_less FROM b WHERE baseline_tokens IS NOT NULL AND reduced_tokens IS NOT NULL"""


def cumulative_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").withColumn("tokens", tokens(F.col("text"), "gemini"))
    return talk.select("conv_id", "turn", T.running_total(talk, "conv_id", ["turn"], "tokens").alias("so_far"))


CUMULATIVE_SQL = "SELECT conv_id, turn, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.75)) END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS so_far FROM conversations"


def zip_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    left = ev.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("query"))
    right = ev.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("step"))
    return T.by_rank(left, right, "user_id", ["ts", "query"], ["at", "step"]).select("user_id", "query", "step")


ZIP_SQL = """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
SELECT a.user_id, a.event_id AS query, b.event_id AS step FROM r a JOIN r b ON a.user_id = b.user_id AND a.n = b.n AND a.event_type = 'view' AND b.event_type = 'click'"""

QUERIES = {"task_windows": task_windows, "lookahead_first": lookahead_first, "duplicate_bounds": duplicate_bounds, "query_session_interval": query_session_interval, "token_attribution": token_attribution, "session_summary": session_summary, "compare_runs": compare_runs, "cumulative_tokens": cumulative_tokens, "zip_by_rank": zip_by_rank}
ORACLE = {"task_windows": WINDOWS_SQL, "lookahead_first": LOOK_SQL, "duplicate_bounds": BOUNDS_SQL, "query_session_interval": SESSION_SQL, "token_attribution": ATTRIBUTION_SQL, "session_summary": SUMMARY_SQL, "compare_runs": COMPARE_SQL, "cumulative_tokens": CUMULATIVE_SQL, "zip_by_rank": ZIP_SQL}
