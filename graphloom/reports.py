"""Small results as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, limit: int = 200) -> str:
    """The first rows of a frame, in its order, as a table."""
    def cell(v) -> str:
        return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    rows = [[cell(v) for v in r] for r in df.limit(limit).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def report(title: str, **parts: DataFrame | str) -> str:
    """A page with a section for each part."""
    out = [f"# {title}"]
    for name, part in parts.items():
        out += [f"## {name.replace('_', ' ').capitalize()}", part if isinstance(part, str) else table(part)]
    return "\n\n".join(out) + "\n"
