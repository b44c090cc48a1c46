"""Equality of graph nodes with missing parts as wildcards.

Two nodes are the same entity if their keys agree and their residuals do. The key is what an equi-join can hash; a missing class or line matches any, so
the relation isn't transitive and can't be one key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE = "struct<type:string,file:string,function:string,class:string,line:int,route:string,method:string,model:string>"


def normal_path(path: Column) -> Column:
    """Backslashes as slashes, `.` and empty segments dropped, `..` folded, a leading slash kept."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    keep = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, part: F.when((part == "") | (part == "."), done)
        .when((part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.when(F.startswith(F.regexp_replace(path, r"\\", "/"), F.lit("/")), "/").otherwise(""), F.array_join(keep, "/"))


def node(type: str | Column, **parts: Column | str | int | None) -> Column:
    """A node struct; parts that aren't given are null."""
    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)

    kinds = {"line": "int"}
    fields = [as_col(type).cast("string").alias("type")]
    for name in ("file", "function", "class", "line", "route", "method", "model"):
        value = parts.get(name, parts.get(f"{name}_"))
        fields.append(as_col(value).cast(kinds.get(name, "string")).alias(name))
    return F.struct(*fields)


def node_key(n: Column) -> Column:
    """What two equal nodes must share exactly; null (equal to nothing) for kinds without identity. A null file is a value like any other."""
    def part(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), n[name]), F.lit("~"))

    return (
        F.when(n["type"] == "DATABASE", F.concat(F.lit("DATABASE\x1f"), part("model")))
        .when(n["type"].isin("FUNCTION", "MIDDLEWARE"), F.concat_ws("\x1f", n["type"], part("file"), part("function")))
        .when(n["type"] == "ROUTE", F.concat_ws("\x1f", n["type"], part("route"), part("method")))
        .when(n["type"].isin("FILE", "MODULE"), F.concat(F.lit("FILE\x1f"), part("file")))
    )


def node_residual(a: Column, b: Column) -> Column:
    """What must hold besides equal keys: classes and lines agree where both are known; files of routes agree where both are given."""
    def agree(name: str) -> Column:
        return a[name].isNull() | b[name].isNull() | (a[name] == b[name])

    def open_(name: str) -> Column:
        return (F.coalesce(a[name], F.lit("")) == "") | (F.coalesce(b[name], F.lit("")) == "") | (a[name] == b[name])

    return F.when(a["type"] == "FUNCTION", open_("class") & agree("line")).when(a["type"] == "ROUTE", open_("file")).otherwise(F.lit(True))


def same_node(a: Column, b: Column) -> Column:
    return F.coalesce((node_key(a) == node_key(b)) & node_residual(a, b), F.lit(False))
