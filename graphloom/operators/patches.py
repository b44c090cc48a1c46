"""Patches as text: blocks and hunks, files after a patch, and whether they parse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = re.compile(r"<{5,}\s*SEARCH[^\n]*\n(.*?)\n?={5,}\n(.*?)\n?>{5,}\s*REPLACE", re.DOTALL)
PAIRS = {")": "(", "]": "[", "}": "{"}


def search_replace(patch: str) -> list[tuple[str, str]]:
    """The (search, replace) blocks of a patch, in order."""
    return [(m[1], m[2]) for m in BLOCK.finditer(patch)]


def apply_patch(content: str, patch: str) -> tuple[str, int]:
    """The text after a patch, and how many of its blocks or hunks could not be placed.

    SEARCH/REPLACE blocks replace the first place of their search text (an empty one appends). Otherwise the patch is a unified diff: each hunk's old lines are replaced where they stand, the place nearest to its line number first.
    """
    if blocks := search_replace(patch):
        lost = 0
        for old, new in blocks:
            if not old:
                content = content.rstrip("\n") + "\n" + new + "\n"
            elif old in content:
                content = content.replace(old, new, 1)
            else:
                lost += 1
        return content, lost
    lines, lost, shift = content.split("\n"), 0, 0
    for head, body in re.findall(r"(?m)^@@ -(\d+)[^\n]*\n((?:[ +\-\\][^\n]*\n?|\n)*)", patch):
        rows = [r for r in body.split("\n") if r and not r.startswith("\\")]
        old, new = [r[1:] for r in rows if r[0] != "+"], [r[1:] for r in rows if r[0] != "-"]
        want = int(head) - 1 + shift
        places = [i for i in range(len(lines) - len(old) + 1) if lines[i : i + len(old)] == old]
        if not places:
            lost += 1
            continue
        at = min(places, key=lambda i: abs(i - want))
        lines[at : at + len(old)] = new
        shift += len(new) - len(old)
    return "\n".join(lines), lost


def parses(file: str, text: str) -> bool:
    """Whether a text is well formed: Python by its parser, others by their brackets outside strings and comments."""
    if file.endswith(".py"):
        import ast

        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError):
            return False
    from ..extract.brace_source import TOKEN

    stack = []
    for m in TOKEN.finditer(text):
        if m.lastgroup == "sign":
            if m.group() in PAIRS.values():
                stack.append(m.group())
            elif m.group() in PAIRS and (not stack or stack.pop() != PAIRS[m.group()]):
                return False
    return not stack


def patched(files: DataFrame, patches: DataFrame) -> DataFrame:
    """patch_id, file, content after the patch, lost (parts that found no place), valid. files: file, content; patches: patch_id, file, patch; a new file starts empty."""
    both = patches.select("patch_id", "file", "patch").join(files.select("file", "content"), "file", "left").select("patch_id", "file", "content", "patch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, old, change = (batch.column(i).to_pylist() for i in range(4))
            made = [apply_patch(c or "", p or "") for c, p in zip(old, change, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32()), pa.array([parses(f, m[0]) for f, m in zip(names, made, strict=True)], pa.bool_())], names=["patch_id", "file", "content", "lost", "valid"])

    return both.withColumn("patch_id", F.col("patch_id").cast("bigint")).mapInArrow(run, "patch_id bigint, file string, content string, lost int, valid boolean")
