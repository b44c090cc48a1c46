"""Joins that take the first match of an ordered list of tries, and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(left: DataFrame, key: str, tries: Column, right: DataFrame, right_key: str, into: str) -> DataFrame:
    """left with `into`: the first of the candidate values `tries` (an array) that occurs in right[right_key], null if none does.

    The candidates are exploded with their places, semi-joined, and the least place wins by min_by, a partial aggregate.
    """
    found = left.select(key, F.posexplode(tries).alias("place", "try")).join(right.select(F.col(right_key).alias("try")).distinct(), "try", "left_semi")
    best = found.groupBy(key).agg(F.min_by("try", "place").alias(into))
    return left.join(best, key, "left")


def nearest_before(calls: DataFrame, defs: DataFrame, on: list[str], call_at: str, def_at: str, payload: list[str], call_key: str) -> DataFrame:
    """As-of join: for each call the definition with the largest `def_at` not above `call_at`, else the smallest above it.

    Both sides are sorted together, once, and each call takes the last definition before it and the first after it; so a key with very many calls and definitions costs their sum and not their
    product. Unmatched calls, and those without a place, stay with nulls.
    """
    call = F.struct(*[F.col(f"`{c}`") for c in calls.columns])
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    found = F.struct(*payload)
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(on)]
    left = calls.select(*keys, F.col(call_at).alias("__at"), F.lit(1).alias("__side"), call.alias("__call"), none(defs, found).alias("__def"))
    known = defs.where(" and ".join(f"`{c}` is not null" for c in [*on, def_at]))
    right = known.select(*keys, F.col(def_at).alias("__at"), F.lit(0).alias("__side"), none(calls, call).alias("__call"), found.alias("__def"))
    line = Window.partitionBy(*[f"__k{i}" for i in range(len(on))]).orderBy("__at", "__side")
    last = F.last("__def", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__def", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    picked = left.unionByName(right).select("__call", "__side", F.when(F.col("__at").isNotNull(), F.coalesce(last, first)).alias("__d")).where("__side = 1")
    return picked.select("__call.*", *[F.col(f"__d.{c}").alias(c) for c in payload])


def enclosing(points: DataFrame, spans: DataFrame, on: list[str], start: str, end: str, span_start: str, span_end: str, point_key: str, payload: list[str], strict: bool = False, width: int = 64) -> DataFrame:
    """The smallest span that contains each point's interval (strictly, if asked), by min_by of the size.

    An interval join in bins: a span is in every bin of `width` that it touches, a point in the bin of its start; so a point meets only the spans near it. width should be about the usual length of a span.
    """
    bin_of = lambda c: F.floor(F.col(c) / width).cast("bigint")
    s = spans.select(*on, F.col(span_start).alias("__s"), F.col(span_end).alias("__e"), F.struct(*payload).alias("__p")).where("__s <= __e")
    s = s.withColumn("__bin", F.explode(F.sequence(bin_of("__s"), bin_of("__e"))))
    inside = (F.col("__s") <= F.col(start)) & (F.col("__e") >= F.col(end))
    if strict:
        inside = inside & ((F.col("__s") != F.col(start)) | (F.col("__e") != F.col(end)))
    hit = points.withColumn("__bin", bin_of(start)).join(s, [*on, "__bin"]).where(inside)
    best = hit.groupBy(point_key).agg(F.min_by("__p", F.struct(F.col("__e") - F.col("__s"), F.col("__s"))).alias("__p"))
    return points.join(best, point_key, "left").select(*points.columns, *[F.col(f"__p.{c}").alias(c) for c in payload])
