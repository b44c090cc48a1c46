"""Text of definitions, views and patches. What no regular expression can say (balanced brackets, attached comments) runs in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CALL = StructType([StructField(n, StringType()) for n in ("head", "name", "args")])


def call_parts(expr: str | None) -> tuple[str | None, str | None, str | None]:
    """What a call is made of: `a.b(c).d(e)` gives a.b(c), d, e; `f(x)` null, f, x; anything else three nulls. A leading await doesn't count."""
    none = (None, None, None)
    text = (expr or "").strip()
    if text.startswith("await "):
        text = text[6:].strip()
    if not text.endswith(")"):
        return none
    depth = 0
    for at in range(len(text) - 1, 0, -1):
        depth += (text[at] == ")") - (text[at] == "(")
        if depth == 0:
            break
    else:
        return none
    callee = text[:at]
    name = re.search(r"[\w$]*\Z", callee)[0]
    before = callee[: len(callee) - len(name)]
    if not name or (before and not before.endswith(".")):
        return none
    return (before[:-1].strip() if before else None), name, text[at + 1 : -1]


@F.pandas_udf(CALL)
def split_call(expr: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([call_parts(e) for e in expr], columns=["head", "name", "args"])


def doc_line(content: str | None, line: int | None, python: bool | None) -> str:
    """The first line of the comment above a definition, or of a Python docstring below it; `line` counts from 1."""
    lines, at = (content or "").split("\n"), (line or 1) - 1
    if python:
        for j in range(at + 1, min(len(lines), at + 4)):
            text = lines[j].strip()
            if text.startswith(('"""', "'''")):
                inner = text.strip("\"'").strip()
                return (inner or (lines[j + 1].strip().strip("\"'").strip() if j + 1 < len(lines) else ""))[:140]
            if text and not text.startswith(("@", "#")) and not text.endswith(":"):
                break
        return ""
    above = next((j for j in range(min(at, len(lines)) - 1, -1, -1) if lines[j].strip()), None)
    if above is None:
        return ""
    text = lines[above].strip()
    if text.startswith("//"):
        return text.lstrip("/ ").strip()[:140]
    if not text.endswith("*/"):
        return ""
    top = next((j for j in range(above, -1, -1) if "/*" in lines[j]), 0)
    bare = (re.sub(r"^[/*]*[ *]*|[ *]*(?:\*/)?[ *]*$", "", x.strip()) for x in lines[top : above + 1])
    return next((x for x in bare if x and not x.startswith("@")), "")[:140]


@F.pandas_udf(StringType())
def first_doc_line(content: pd.Series, line: pd.Series, python: pd.Series) -> pd.Series:
    return pd.Series([doc_line(*row) for row in zip(content, line, python, strict=True)])


def signature(content: Column, line: Column, python: Column, most: int = 3) -> Column:
    """The head of a definition: from its line to the one that opens the body, `most` lines and 200 characters at most (a summary for reports)."""
    rows = F.transform(F.slice(F.split(content, "\n"), line, most), lambda x: F.rtrim(x))
    opens = lambda x: F.when(python, x.endswith(":")).otherwise(F.contains(x, F.lit("{")) | x.endswith("=>") | x.endswith(";"))
    ends = F.filter(F.transform(rows, lambda x, i: F.when(opens(x), i + 1)), lambda i: i.isNotNull())
    head = F.slice(rows, 1, F.coalesce(F.get(ends, F.lit(0)), F.lit(most)))
    return F.substring(F.array_join(F.transform(head, lambda x: F.trim(x)), " "), 1, 200)


def viewed_lines(content: Column) -> Column:
    """(number, text) of every line of the form `12: text` of a numbered view."""
    found = F.transform(F.split(content, "\n"), lambda x: F.struct(F.regexp_extract(x, r"(?s)^\s*(\d+):(?:\s.*)?$", 1).alias("number"), F.regexp_extract(x, r"(?s)^\s*\d+:\s(.*)$", 1).alias("text")))
    return F.transform(F.filter(found, lambda x: x["number"] != ""), lambda x: F.struct(x["number"].cast("int").alias("number"), x["text"].alias("text")))


def viewed_code(content: Column) -> Column:
    """The code of a numbered view, with the empty lines after its first line; a text without numbered lines as it is."""
    numbered = r"(?s)^\s*\d+:\s(.*)$"
    rows = F.split(content, "\n")
    first = F.array_position(F.transform(rows, lambda x: x.rlike(numbered)), True)
    kept = F.filter(rows, lambda x, i: x.rlike(numbered) | ((x == "") & (i >= first)))
    return F.when(first > 0, F.array_join(F.transform(kept, lambda x: F.regexp_extract(x, numbered, 1)), "\n")).otherwise(content)


def virtual_patch(code: Column, patch: Column) -> Column:
    """code as a patch would leave it: every text of a removed line is taken out wherever it stands, one after the other, and the added lines go to the end."""
    lines = F.split(F.regexp_replace(patch, "\r\n?", "\n"), "\n")
    taken = lambda sign: F.transform(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.substring(x, F.lit(2), F.length(x)))
    left = F.reduce(F.filter(taken("-"), lambda x: x != ""), code, lambda now, gone: F.replace(now, gone, F.lit("")))
    added = taken("+")
    return F.when(F.size(added) > 0, F.concat(left, F.lit("\n"), F.array_join(added, "\n"))).otherwise(left)


def target_task(target: Column, policy: Column) -> Column:
    """A label for a task from its target and policy."""
    part = lambda n: F.coalesce(F.get(F.split(target, ":"), F.lit(n)), F.lit(""))
    route = F.concat(F.lit("Implement/Fix route: "), F.upper(part(1)), F.lit(" "), part(2), F.lit(" ("), policy, F.lit(")"))
    return F.when(target.startswith("ROUTE:"), route).otherwise(F.concat(F.lit("Task target: "), target, F.lit(" ("), policy, F.lit(")")))


