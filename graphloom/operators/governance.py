"""Review rules as ordered cases: confidence of a review, risk bands, intent, policy, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What raises and lowers the confidence of a review, from 0.5 on, and where it approves.
RAISES = {"tests_pass": 0.2, "small": 0.1, "covered": 0.15, "single_file": 0.05}
LOWERS = {"security": 0.3, "breaking": 0.2, "unresolved": 0.1, "database": 0.1}
APPROVE = 0.7
# Text of each type of change.
TEXTS = {"NEW_PUBLIC_API": "A new public route: check its input and who may call it.", "BREAKING_API_CHANGE": "A public route is gone: find its callers first.", "DATABASE_CHANGE": "New database access: check the query and its index.", "NEW_EXECUTION_PATH": "A new execution path: check that tests reach it."}


def confidence(flags: dict[str, Column]) -> Column:
    """0.5 plus what raises and less what lowers it, within 0 and 1. A null flag counts as not set."""
    total = F.lit(0.5)
    for name, flag in flags.items():
        total = total + F.when(F.coalesce(flag, F.lit(False)), RAISES.get(name, 0.0) - LOWERS.get(name, 0.0)).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def policy(score: Column, security: Column, breaking: Column, reach: Column, wide: int = 5) -> Column:
    """BLOCK before MANUAL_REVIEW before LOW_CONFIDENCE before APPROVE; the order is the meaning."""
    return F.when(security, "BLOCK").when(breaking | (reach > wide), "MANUAL_REVIEW").when(score < APPROVE, "LOW_CONFIDENCE").otherwise("APPROVE")


def risk(reach: Column, wide: int = 5) -> Column:
    return F.when(reach > wide, "HIGH").otherwise("MEDIUM")


def band(score: Column) -> Column:
    return F.when(score >= 0.85, "LOW_RISK").when(score >= APPROVE, "MODERATE_RISK").when(score >= 0.4, "HIGH_RISK").otherwise("CRITICAL_RISK")


def intent(text: Column) -> Column:
    """The first intent that a description's words show."""
    low = F.lower(text)
    return F.when(low.rlike(r"\b(fix|bug|error|crash|wrong)"), "BUG_FIX").when(low.rlike(r"\b(secur|vuln|inject|sanitiz|escape)"), "SECURITY").when(low.rlike(r"\b(refactor|rename|clean|extract|simplif)"), "REFACTOR").when(low.rlike(r"\b(test|coverage|assert)"), "TEST").when(low.rlike(r"\b(add|new|feature|support|implement)"), "FEATURE").otherwise("OTHER")


def review_text(changes: DataFrame) -> DataFrame:
    """changes (type) with the text of their type: a join with a small fixed table, as a map literal."""
    texts = F.create_map(*[F.lit(x) for pair in TEXTS.items() for x in pair])
    return changes.withColumn("text", F.coalesce(F.try_element_at(texts, F.col("type")), F.lit("")))
