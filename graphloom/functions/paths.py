"""Predicates and classes of file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that a scan leaves out; names of test folders; endings of test files; extensions that are indexed.
IGNORED_DIRS = ".git .venv venv __pycache__ node_modules dist build .sandbox .semantic_cache docs docs_api extern".split()
TEST_DIRS = "__tests__ e2e spec specs test testing tests".split()
TEST_FILE = r"(^|/)(test_[^/]*\.py|[^/]*_test\.(py|go)|conftest\.py|[^/]*\.(test|spec)\.[cm]?[jt]sx?|[^/]*Tests?\.java)$"
EXTENSIONS = ".c .cc .cjs .cpp .go .h .hpp .java .js .jsx .mjs .py .rs .ts .tsx".split()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def is_ignored(path: Column) -> Column:
    folders = F.split(path, "/")
    return F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRS)))


def is_test(path: Column) -> Column:
    """In a folder of tests, or named as a test file."""
    folders = F.split(path, "/")
    inside = F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*map(F.lit, TEST_DIRS)))
    return inside | path.rlike(TEST_FILE)


def is_bundle(path: Column) -> Column:
    return path.rlike(r"(^|/)(dist|build|bundle|vendor)/|\.min\.[cm]?js$|\.bundle\.[cm]?js$")


def is_source(path: Column, tests: bool = True) -> Column:
    wanted = extension(path).isin(*EXTENSIONS) & ~is_ignored(path) & ~path.rlike(r"\.min\.[cm]?js$")
    return wanted if tests else wanted & ~is_test(path)


def category(path: Column, prefixes: dict[str, list[str]], other: str = "external") -> Column:
    """The first name of `prefixes` one of whose prefixes the lower-cased path has, else `other`."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    out = F.lit(other)
    for name, starts in reversed(prefixes.items()):
        hit = F.lit(False)
        for start in starts:
            hit = hit | low.startswith(start)
        out = F.when(hit, name).otherwise(out)
    return out


def kind(path: Column, core: Column) -> Column:
    """Class of a file for attribution; `core`: whether it is in the route's core."""
    low = F.lower(path)
    return (
        F.when(core, "CORE_ROUTE").when(is_test(low), "TEST").when(low.contains("benchmark"), "BENCHMARK").when(low.contains("telemetry"), "TELEMETRY")
        .when(low.rlike(r"\.(json|ya?ml|toml|ini|cfg|env)$"), "CONFIG").when(low.rlike(r"(^|/)(infra|middleware|server|app|index|main)[./]"), "INFRASTRUCTURE")
        .when(extension(low).isin(*EXTENSIONS), "DEPENDENCY").otherwise("UNKNOWN")
    )
