"""Scores of selections, audits and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Penalties of the simulation and of the trust score, the APIs that are dangerous, and the score from which a patch is safe or trusted.
SIMULATION = {"unknown_variable": 0.05, "unresolved_call": 0.25, "missing_await": 0.35, "broken_return": 0.10}
TRUST = {"dangerous": 0.5, "unknown": 0.2, "tainted": 0.4}
DANGEROUS = ("eval", "exec", "Function", "child_process")
SAFE = 0.7
# Words that aren't identifiers of a patch.
KEYWORDS = "and as async await break case catch class const continue def del do elif else except export extends false finally for from function if import in is lambda let new none not null or pass raise return self switch this throw true try typeof undefined var void while with yield".split()


def recall_precision(actual: Column, selected: Column) -> dict[str, Column]:
    """tp, fp, fn, recall and precision (1 where there is nothing to find, or nothing was selected) of two arrays of distinct values."""
    tp = F.size(F.array_intersect(actual, selected))
    n, m = F.size(actual), F.size(selected)
    return {"tp": tp, "fp": m - tp, "fn": n - tp, "recall": F.when(n == 0, 1.0).otherwise(F.round(tp / n, 4)), "precision": F.when(m == 0, 1.0).otherwise(F.round(tp / m, 4))}


def recall_precision_by(rows: DataFrame, by: list[str], actual: Column, selected: Column) -> DataFrame:
    """The same for each group of rows, of which `actual` and `selected` say whether a row is in either set: conditional sums, so no set is gathered."""
    a, s = F.coalesce(actual, F.lit(False)), F.coalesce(selected, F.lit(False))
    sums = rows.groupBy(*by).agg(F.count(F.when(a & s, 1)).alias("tp"), F.count(F.when(~a & s, 1)).alias("fp"), F.count(F.when(a & ~s, 1)).alias("fn"))
    share = lambda part, whole: F.when(whole == 0, 1.0).otherwise(F.round(part / whole, 4))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(*by, *[c.cast("int").alias(n) for n, c in (("tp", tp), ("fp", fp), ("fn", fn))], share(tp, tp + fn).alias("recall"), share(tp, tp + fp).alias("precision"))


def efficiency(context: Column, whole: Column) -> Column:
    """Percent of the whole that the context leaves out, 0 to 100, two places."""
    return F.when(whole <= 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - context / whole) * 100)), 2))


def cost(input_tokens: Column, output_tokens: Column, per_million_in: float, per_million_out: float) -> Column:
    return F.round(input_tokens * per_million_in / 1e6 + output_tokens * per_million_out / 1e6, 6)


def precision_audit(sample: DataFrame, kind: str = "kind") -> DataFrame:
    """By kind, and over all kinds as ALL: total, unknown to the oracle, judged, agreeing, precision. sample: kind, ours, oracle (array; empty or null: unknown)."""
    judged = F.coalesce(F.size("oracle"), F.lit(0)) > 0
    agree = judged & F.coalesce(F.array_contains("oracle", F.col("ours")), F.lit(False))
    sums = sample.rollup(kind).agg(F.count("*").alias("total"), F.sum(F.when(judged, 0).otherwise(1)).alias("unknown"), F.sum(F.when(judged, 1).otherwise(0)).alias("judged"), F.sum(F.when(agree, 1).otherwise(0)).alias("agree"), F.grouping(kind).alias("__g"))
    return sums.select(F.when(F.col("__g") == 1, "ALL").otherwise(F.col(kind)).alias("kind"), "total", "unknown", "judged", "agree", F.when(F.col("judged") > 0, F.round(F.col("agree") / F.col("judged"), 4)).alias("precision"))


def added_lines(patch: Column) -> Column:
    """Lines that a patch adds, without their plus sign; all lines of a text without any."""
    lines = F.split(patch, "\n")
    plus = F.filter(lines, lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")))
    return F.when(F.size(plus) > 0, F.transform(plus, lambda x: F.substring(x, 2, 1_000_000_000))).otherwise(lines)


def with_added(patches: DataFrame, patch: str) -> DataFrame:
    """patches with added_lines and added_text of a patch. They go through explode, so that what uses them several times doesn't cut the patch up again each time."""
    return patches.select("*", F.explode(F.array(added_lines(F.col(patch)))).alias("added_lines")).select("*", F.explode(F.array(F.array_join("added_lines", "\n"))).alias("added_text"))


def patch_features(lines: Column, text: Column) -> dict[str, Column]:
    """Sets of declared variables, called functions, member expressions, assigned names and identifiers of the added lines, and the number of comments. lines, text: of with_added()."""
    find = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)))
    return {
        "declared": find(r"\b(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
        "called": find(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("),
        "members": find(r"([A-Za-z_$][A-Za-z0-9_$]*\.[A-Za-z_$][A-Za-z0-9_$]*)"),
        "assigned": find(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*=[^=>]"),
        "identifiers": F.filter(find(r"([A-Za-z_$][A-Za-z0-9_$]*)"), lambda x: ~F.lower(x).isin(*KEYWORDS)),
        "comments": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^(//|#|/\*)"))),
    }


def _penalised(counts: dict[str, Column], weights: dict[str, float]) -> Column:
    lost = sum((counts[k] * w for k, w in weights.items() if k in counts), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - lost)), 4)


def simulation_score(counts: dict[str, Column]) -> Column:
    """1 less the penalties of unknown variables, unresolved calls, missing awaits and a broken return flow, within 0 and 1; safe from SAFE on."""
    return _penalised(counts, SIMULATION)


def trust_score(called: Column, members: Column, known: Column, tainted: Column) -> Column:
    """1 less the penalties: each dangerous API, each unknown function and each tainted use."""
    dangerous = F.size(F.filter(called, lambda x: x.isin(*DANGEROUS))) + F.size(F.filter(members, lambda x: F.split(x, r"\.")[0].isin(*DANGEROUS)))
    unknown = F.size(F.array_except(F.filter(called, lambda x: ~x.isin(*DANGEROUS)), known))
    return _penalised({"dangerous": dangerous, "unknown": unknown, "tainted": tainted}, TRUST)


def safety(trust: Column, simulation: Column, *flags: Column) -> tuple[Column, Column]:
    """The smaller of both scores, and whether both and all flags are good."""
    ok = (trust >= SAFE) & (simulation >= SAFE)
    for flag in flags:
        ok = ok & flag
    return F.least(trust, simulation), ok


def security_tag(line: Column) -> Column:
    low = F.lower(line)
    return (
        F.when(low.rlike(r"\b(select|insert|update|delete)\b.*\b(from|into|set)\b"), "RAW_SQL").when(low.rlike(r"passw|passwd|pwd"), "PASSWORD_FLOW")
        .when(low.rlike(r"token|jwt|secret"), "TOKEN_USAGE").when(low.rlike(r"req\.(body|query|params)|input\("), "USER_INPUT")
    )


def approval(score: Column, high_risk: Column, security: Column) -> Column:
    """The ordered rules of the review policy."""
    return F.when(security, "BLOCK").when(high_risk, "MANUAL_REVIEW").when(score < SAFE, "LOW_CONFIDENCE").otherwise("APPROVE")


def benchmark_summary(results: DataFrame) -> DataFrame:
    """Averages over all tasks of a benchmark, and the cost of them together; no row without results.

    results: edit_recall, edit_precision, context_efficiency, hallucination_rate, test_pass_rate, cost_usd, latency_seconds.
    """
    mean = lambda c, to, name: F.round(F.avg(c), to).alias(name)
    out = results.agg(
        mean("edit_recall", 4, "avg_recall"), mean("edit_precision", 4, "avg_precision"), mean("context_efficiency", 2, "avg_context_efficiency"), mean("hallucination_rate", 2, "avg_hallucination_rate"),
        mean("test_pass_rate", 4, "test_pass_rate"), F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"), mean("latency_seconds", 2, "avg_latency_seconds"), F.count("*").alias("tasks"),
    )
    return out.where("tasks > 0")
