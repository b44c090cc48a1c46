"""Change detection, diffs, merges and delta maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_diff(old: DataFrame, new: DataFrame, key: str = "file", digest: str = "sha256") -> DataFrame:
    """key, change (added, changed, deleted): a full outer join of two hash tables; equal ones don't appear."""
    a, b = old.select(F.col(key).alias("__k"), F.col(digest).alias("__a"), F.lit(True).alias("__in")), new.select(key, F.col(digest).alias("__b"), F.lit(True).alias("__now"))
    both = a.join(b, F.col("__k") == F.col(key), "full_outer")
    change = F.when(F.col("__in").isNull(), "added").when(F.col("__now").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(F.coalesce(key, "__k").alias(key), change.alias("change")).where("change is not null")


def graph_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are new or gone, by `keys`; repeated rows stay repeated (anti-joins, not set differences)."""
    def without(a: DataFrame, b: DataFrame, what: str) -> DataFrame:
        other = b.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return a.join(other, on, "left_anti").select(*keys, F.lit(what).alias("change"))

    return without(new, old, "new").unionByName(without(old, new, "removed"))


def definition_digest(functions: DataFrame, columns: list[str], key: str = "file") -> DataFrame:
    """A digest of each file's definitions, whatever their order: what must change before dependents are looked at again."""
    return functions.groupBy(key).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))), 256).alias("digest"))


def apply_update(current: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "file") -> DataFrame:
    """current without the rows of changed keys, and the fresh rows of these: delete by key and insert. changed has deleted keys as well."""
    gone = changed.select(F.col(key).alias("__k")).distinct()
    kept = current.join(gone, current[key] == F.col("__k"), "left_anti")
    return kept.unionByName(fresh.join(gone, fresh[key] == F.col("__k"), "left_semi"))


def dependents_to_update(imports: DataFrame, before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that import a changed file whose definitions moved (digests differ); empty when only bodies changed."""
    moved = changed.join(before.withColumnRenamed("digest", "__a"), "file", "left").join(after.withColumnRenamed("digest", "__b"), "file", "left").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(F.col("file").alias("resolved_file"))
    return imports.join(moved.distinct(), "resolved_file", "left_semi").select("file").distinct().join(changed.select("file"), "file", "left_anti")


def classify_changes(diff: DataFrame) -> DataFrame:
    """Classes and risks of a diff's rows. diff: section (routes, database, execution_edges), change, name."""
    kind = (
        F.when((F.col("section") == "routes") & (F.col("change") == "new"), F.struct(F.lit("NEW_PUBLIC_API").alias("type"), F.lit("MEDIUM").alias("risk")))
        .when((F.col("section") == "routes") & (F.col("change") == "removed"), F.struct(F.lit("BREAKING_API_CHANGE").alias("type"), F.lit("HIGH").alias("risk")))
        .when((F.col("section") == "database") & (F.col("change") == "new"), F.struct(F.lit("DATABASE_CHANGE").alias("type"), F.lit("HIGH").alias("risk")))
        .when((F.col("section") == "execution_edges") & (F.col("change") == "new"), F.struct(F.lit("NEW_EXECUTION_PATH").alias("type"), F.lit("MEDIUM").alias("risk")))
    )
    return diff.withColumn("__k", kind).where("__k is not null").select("section", "name", "__k.type", "__k.risk")


def changed_functions(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Functions whose span holds a changed line: an equi-join on the file with a range condition. lines: file, line."""
    hit = functions.join(lines, "file").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return hit.select(*functions.columns).distinct()


def merge_trace(edges: DataFrame, trace: DataFrame, keys: list[str], stale: Column | None = None, tests: int = 5) -> DataFrame:
    """Static edges with what was observed: counts, the first tests by name, confidence; observed pairs without an edge are added. Merging again changes nothing.

    edges: keys, confidence; trace: keys, test, count. stale: a condition on the keys under which an observation no longer holds.
    """
    fresh = trace if stale is None else trace.where(~stale)
    from pyspark.sql import Window

    by_test = fresh.groupBy(*keys, "test").agg(F.sum("count").alias("count"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("test").asc_nulls_last()))
    seen = by_test.withColumn("__n", nth).groupBy(*keys).agg(F.sum("count").alias("observed_count"), F.sort_array(F.collect_list(F.when(F.col("__n") <= tests, F.col("test")))).alias("observed_in"))
    static = edges.select(*keys, F.coalesce("static_confidence", "confidence").alias("confidence") if "static_confidence" in edges.columns else F.col("confidence")).where("confidence is null or confidence <> 'trace-only'").withColumn("static", F.lit(True))
    both = static.join(seen, keys, "full_outer")
    observed = F.col("observed_count").isNotNull()
    return both.select(*keys, F.when(observed, "observed").otherwise(F.coalesce("confidence", F.lit("resolved"))).alias("confidence"), F.when(F.col("static").isNull(), "trace-only").otherwise(F.coalesce("confidence", F.lit("resolved"))).alias("static_confidence"), observed.alias("observed"), F.coalesce("observed_count", F.lit(0)).alias("observed_count"), F.coalesce("observed_in", F.array().cast("array<string>")).alias("observed_in"))


def prune_fanout(edges: DataFrame) -> DataFrame:
    """Of a call with several targets of which some were observed, the others become `unobserved`. edges: call_id, observed, confidence."""
    from pyspark.sql import Window

    call = Window.partitionBy("call_id")
    seen = F.max(F.coalesce("observed", F.lit(False))).over(call)
    many = F.count("*").over(call) > 1
    demote = F.col("call_id").isNotNull() & many & seen & ~F.coalesce("observed", F.lit(False))
    return edges.withColumns({"static_confidence": F.when(demote, F.col("confidence")), "confidence": F.when(demote, "unobserved").otherwise(F.col("confidence"))})
