"""Transcripts of agents as ordered logs: task windows, token attribution, sessions and comparisons.

Steps: session_id, step_idx, type, source, content, created_at, path; queries of the engine are steps with is_query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Category of a step's type; others are tool output.
CATEGORIES = {
    "USER_INPUT": "user_tokens", "PLANNER_RESPONSE": "planner_tokens", "VIEW_FILE": "file_view_tokens", "GREP_SEARCH": "search_tokens",
    "MCP_TOOL": "mcp_tokens", "RUN_COMMAND": "command_tokens", "ERROR_MESSAGE": "diagnostic_tokens", "SYSTEM_MESSAGE": "diagnostic_tokens",
}
OTHER = "tool_output_tokens"
INJECTED = ("file_view_tokens", "search_tokens", "mcp_tokens", "command_tokens")


def category(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair]), kind), F.lit(OTHER))


def task_windows(steps: DataFrame, session: str, order: list[str], boundary: Column) -> DataFrame:
    """steps with window_id: a window has the steps after one boundary up to and including the next; what follows the last boundary is a trailing window."""
    before = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("window_id", F.coalesce(F.sum(F.when(boundary, 1).otherwise(0)).over(before), F.lit(0)).cast("int"))


def window_bounds(windows: DataFrame, session: str, at: str) -> DataFrame:
    """Start, end and seconds of each window, and whether it is of length zero, or shares its bounds with another window of any session."""
    spans = windows.groupBy(session, "window_id").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("steps"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    same = Window.partitionBy("start", "end")
    return spans.withColumns({"seconds": (micros("end") - micros("start")) / 1e6, "zero_length": F.col("start") == F.col("end"), "duplicate": F.count("*").over(same) > 1})


def look_ahead(steps: DataFrame, session: str, order: list[str], wanted: Column, value: Column, reach: int = 9) -> Column:
    """The first value of a wanted step among the next `reach` steps."""
    ahead = Window.partitionBy(session).orderBy(*order).rowsBetween(1, reach)
    return F.first(F.when(wanted, value), ignorenulls=True).over(ahead)


def in_session(queries: DataFrame, sessions: DataFrame, by: list[str], query_key: str, at: str, seconds: int = 3600) -> DataFrame:
    """Each query with the first session (by start, then id) of the same `by` that holds its time: an interval join in bins of `seconds`, which should be about the usual length of a session, and a min_by."""
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds).cast("bigint")
    s = sessions.select(*by, F.col("session_id").alias("__sid"), F.col("start").alias("__s"), F.col("end").alias("__e")).where("__s <= __e")
    s = s.withColumn("__bin", F.explode(F.sequence(bin_of("__s"), bin_of("__e"))))
    hit = queries.withColumn("__bin", bin_of(at)).join(s, [*by, "__bin"]).where((F.col("__s") <= F.col(at)) & (F.col(at) <= F.col("__e")))
    first = hit.groupBy(query_key).agg(F.min_by("__sid", F.struct("__s", "__sid")).alias("session_id"))
    return queries.join(first, query_key, "left")


def by_rank(left: DataFrame, right: DataFrame, group: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The i-th row of left with the i-th of right, in each group (a zip by rank)."""
    n = lambda df, order: df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return n(left, left_order).join(n(right, right_order), [group, "__n"]).drop("__n")


def attribution(windows: DataFrame, keys: list[str], kind: Column, tokens: Column) -> DataFrame:
    """Tokens of each category, what was injected into the context, and the total, for each window: one pass of conditional sums."""
    names = [*dict.fromkeys([*CATEGORIES.values(), OTHER])]
    held = windows.withColumns({"__c": category(kind), "__t": tokens})
    sums = held.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("__c") == n, F.col("__t"))), F.lit(0)).alias(n) for n in names])
    total = lambda cols: sum((F.col(c) for c in cols), F.lit(0))
    return sums.withColumns({"injected_tokens": total(INJECTED), "total_tokens": total(names)})


def session_summary(steps: DataFrame, session: str, path: Column, edit: Column, tokens: Column, chars: Column, group: Column) -> DataFrame:
    """Per session: files opened and modified (distinct), characters, tokens by group of path, and how often the most opened file was opened."""
    held = steps.withColumns({"__p": path, "__e": edit, "__t": tokens, "__c": chars, "__g": group})
    opened = held.where("__p is not null").groupBy(session, "__p").agg(F.count("*").alias("n")).groupBy(session).agg(F.max("n").alias("most_opened"))
    sums = held.groupBy(session).agg(F.count_distinct("__p").alias("files_opened"), F.count_distinct(F.when(F.col("__e"), F.col("__p"))).alias("files_modified"), F.sum("__c").alias("chars"), F.sum("__t").alias("tokens"), F.sum(F.when(F.col("__g") == "repo", F.col("__t")).otherwise(0)).alias("repo_tokens"), F.sum(F.when(F.col("__g") != "repo", F.col("__t")).otherwise(0)).alias("external_tokens"))
    return sums.join(opened, session, "left").withColumn("most_opened", F.coalesce("most_opened", F.lit(0)))


def compare_runs(runs: DataFrame) -> DataFrame:
    """Baseline against the other mode for each task: totals, tokens saved, percent less, inflation. runs: task, mode, total_tokens, seconds."""
    base, new = F.col("mode") == "baseline", F.col("mode") != "baseline"
    both = runs.groupBy("task").agg(F.sum(F.when(base, F.col("total_tokens"))).alias("baseline_tokens"), F.sum(F.when(new, F.col("total_tokens"))).alias("reduced_tokens"), F.sum(F.when(base, F.col("seconds"))).alias("baseline_seconds"), F.sum(F.when(new, F.col("seconds"))).alias("reduced_seconds"))
    less = F.when(F.col("baseline_tokens") > 0, F.round((1 - F.col("reduced_tokens") / F.col("baseline_tokens")) * 100, 2)).otherwise(0.0)
    return both.where("baseline_tokens is not null and reduced_tokens is not null").withColumns({"saved": F.col("baseline_tokens") - F.col("reduced_tokens"), "percent_less": less})


def relative_error(estimate: Column, truth: Column) -> Column:
    return F.when(truth == 0, F.when(estimate == 0, 0.0).otherwise(1.0)).otherwise(F.abs(estimate - truth) / F.abs(truth))


def running_total(df: DataFrame, session: str, order: list[str], value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def session_savings(queries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each session against its queries: tokens read, tokens of the queries' contexts, files of either and both, percent less; sessions without queries keep zeros.

    sessions: session_id, tokens, files (array); queries: session_id, context_tokens, files (array).
    """
    q = queries.groupBy("session_id").agg(F.count("*").alias("queries"), F.sum("context_tokens").alias("context_tokens"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("selected"))
    none = F.array().cast("array<string>")
    both = sessions.join(q, "session_id", "left").withColumns({"queries": F.coalesce("queries", F.lit(0)), "context_tokens": F.coalesce("context_tokens", F.lit(0)), "selected": F.coalesce("selected", none)})
    less = F.when(F.col("tokens") > 0, F.round((1 - F.col("context_tokens") / F.col("tokens")) * 100, 2)).otherwise(0.0)
    return both.select("session_id", "queries", "tokens", "context_tokens", less.alias("percent_less"), F.size(F.array_union("files", "selected")).alias("files_of_either"), F.size(F.array_intersect("files", "selected")).alias("files_of_both"))
