"""Queries of the streaming family, drained over the events there are; the SQL is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import live as V

_STREAM = lambda spark, sf_dir: V.read_stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def stream_live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return V.drain(V.live_counters(_STREAM(spark, sf_dir), "user_id", F.col("event_type"), k))


COUNTERS_SQL = "SELECT user_id, event_type AS category, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY ALL"


def stream_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps of at most two hours; in complete mode, so that the last ones of the finite stream are there as well."""
    found = V.drain(V.sessions(_STREAM(spark, sf_dir), "at", "2 hours", "user_id"))
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


SESSIONS_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 2 HOUR) AS "end", count(*) AS n FROM s GROUP BY user_id, k"""


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.drain(V.tumbling(_STREAM(spark, sf_dir), "at", "6 hours", ["event_type"], F.count("*").alias("n")))
    return found.select(F.unix_micros("start").alias("start"), "event_type", "n")


TUMBLING_SQL = "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"

QUERIES = {"stream_live_counters": stream_live_counters, "stream_session_windows": stream_session_windows, "stream_tumbling": stream_tumbling}
ORACLE = {"stream_live_counters": COUNTERS_SQL, "stream_session_windows": SESSIONS_SQL, "stream_tumbling": TUMBLING_SQL}
