"""Order of the confidence labels of edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of each label; an unknown label counts as 2.
RANKS = {"observed": 4, "resolved": 3, "uses": 3, "name-unique": 2, "candidates": 2, "dispatch": 2, "dynamic": 2, "convention": 2, "nested": 2, "unobserved": 1}
UNKNOWN = 2


def edge_confidence(confidence: Column, observed: Column | None = None, source: Column | None = None) -> Column:
    """`observed` where the edge was seen at run time, else its own label, else `resolved`."""
    seen = F.lit(False)
    if observed is not None:
        seen = seen | F.coalesce(observed, F.lit(False))
    if source is not None:
        seen = seen | F.coalesce(source == "trace", F.lit(False))
    return F.when(seen, "observed").otherwise(F.coalesce(confidence, F.lit("resolved")))


def rank(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), F.lit(UNKNOWN))


def at_least(label: Column, minimum: str | None) -> Column:
    return F.lit(True) if minimum is None else rank(label) >= RANKS.get(minimum, UNKNOWN)
