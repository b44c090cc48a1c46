"""String functions over identifiers, code text and tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search leaves out.
STOP_WORDS = "a an and are as at be by for from has have how i if in into is it its no not of on or so that the their then there these this to was we what when where which will with you".split()
#: Characters for one token of each estimator, and the least estimate of a text that isn't empty.
ESTIMATORS = {"default": (4.0, 0), "gemini": (3.75, 1), "llama": (3.25, 1)}


def subwords(name: Column, least: int = 3) -> Column:
    """Parts of a camelCase, snake_case or numbered identifier of `least` characters or more, lower-cased, in order."""
    parts = F.regexp_extract_all(name, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"), 0)
    return F.filter(F.transform(parts, lambda x: F.lower(x)), lambda x: F.length(x) >= least)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0)


def query_words(text: Column) -> Column:
    """Distinct lower-cased words of a query without stop words."""
    return F.array_except(F.array_distinct(F.transform(words(text), lambda x: F.lower(x))), F.array(*map(F.lit, STOP_WORDS)))


def idf(df: Column, total: Column) -> Column:
    """max(0.15, 1 - log(1 + df) / log(1 + total))."""
    return F.greatest(F.lit(0.15), 1 - F.log1p(df) / F.log1p(total))


def tokens(text: Column, estimator: str = "default") -> Column:
    """Estimated tokens of a text; none for a null or empty one."""
    per, least = ESTIMATORS[estimator]
    size = F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(least), F.floor(size / F.lit(per)))).cast("bigint")


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive) of a text."""
    return F.array_join(F.slice(F.split(content, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def call_id(file: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", file, start.cast("string"), end.cast("string"))


def instantiated_class(expr: Column) -> Column:
    """The class of `new X(` or `pkg.X(`, where X has a capital; null otherwise."""
    new = F.regexp_extract(expr, r"^\s*new\s+(?:[\w$]+\.)*([A-Za-z_$][\w$]*)", 1)
    call = F.regexp_extract(expr, r"^\s*(?:[\w$]+\.)*([A-Z][\w$]*)\s*\(", 1)
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(call, F.lit("")))


def iso_timestamp(text: Column) -> Column:
    """The first of three ISO forms that fits, without a trailing Z; null if none does."""
    bare = F.regexp_replace(F.trim(text), "Z$", "")
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss"]
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in forms])


def min_sec(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%dm %ds", F.floor(whole / 60).cast("bigint"), (whole % 60).cast("bigint"))


def percent_less(now: Column, before: Column) -> Column:
    return F.when(before > 0, (1 - now / before) * 100).otherwise(0.0)
