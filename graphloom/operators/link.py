"""Edges that no call site shows: uses of attributes and constants, fixtures, aliases of functions, declarations found near a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_slice
from ..plans.closure import reach
from ..plans.nodes import node


def _edges(df: DataFrame, dst: Column, confidence: str, via: str) -> DataFrame:
    src = node("FUNCTION", file=F.col("file"), function=F.col("function"), class_=F.col("class"))
    return df.select(F.lit("FUNCTION_CALL").alias("edge_type"), src.alias("src"), dst.alias("dst"), F.lit(None).cast("string").alias("call_id"), F.coalesce("is_test", F.lit(False)).alias("is_test"), F.lit(confidence).alias("confidence"), F.lit(via).alias("via")).distinct()


def bodies(functions: DataFrame, files: DataFrame) -> DataFrame:
    """file, function, class, is_test, body of every function; the text of a file is split once for each of its functions."""
    f = functions.select("file", F.col("name").alias("function"), "class", "is_test", "start_line", "end_line")
    return f.join(files.select("file", "content"), "file").select("file", "function", "class", "is_test", line_slice(F.col("content"), F.col("start_line"), F.col("end_line")).alias("body"))


def attribute_uses(body: DataFrame, attributes: DataFrame, classes: DataFrame, depth: int = 8) -> DataFrame:
    """Functions that read a class attribute as self.x, cls.x or this.x (the nearest class upwards that has it) or as Class.x.

    The names in a body are taken out once and joined, so the cost is that of the text and not of attributes times bodies. attributes: class, name, file.
    """
    used = body.select("file", "function", "class", "is_test", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b((?:self|cls|this|[A-Z]\w*)\.[A-Za-z_]\w*)\b(?!\s*\()"), 1))).alias("use"))
    parts = used.withColumns({"owner": F.split("use", r"\.")[0], "name": F.split("use", r"\.")[1]})
    links = classes.where("superclass is not null").select(F.col("class").alias("src_key"), F.col("superclass").alias("dst_key")).distinct().withColumn("edge_id", F.xxhash64("src_key", "dst_key"))
    starts = parts.where("owner in ('self', 'cls', 'this') and class is not null").select(F.col("class").alias("seed_id"), F.col("class").alias("key")).distinct()
    chain = reach(links, starts, "down", depth).select(F.col("seed_id").alias("class"), F.col("key").alias("at_class"), "depth")
    have = attributes.select(F.col("class").alias("at_class"), "name", F.col("file").alias("at_file"))
    own = parts.where("owner in ('self', 'cls', 'this')").join(chain, "class").join(have, ["at_class", "name"])
    near = Window.partitionBy("file", "function", "class", "name").orderBy("depth", "at_class", "at_file")
    own = own.withColumn("__n", F.row_number().over(near)).where("__n = 1").select("file", "function", "class", "is_test", "name", "at_class", "at_file")
    named = parts.where("owner not in ('self', 'cls', 'this')").join(have, (F.col("owner") == F.col("at_class")) & (parts["name"] == have["name"])).select("file", "function", "class", "is_test", parts["name"], "at_class", "at_file")
    both = own.unionByName(named)
    return _edges(both, node("FUNCTION", file=F.col("at_file"), function=F.col("name"), class_=F.col("at_class")), "uses", "attribute")


def constant_uses(body: DataFrame, constants: DataFrame, imports: DataFrame) -> DataFrame:
    """Functions whose body names a module's constant, of their own file or imported by name. constants: file, name."""
    words = body.select("file", "function", "class", "is_test", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\b"), 1))).alias("word"))
    own = constants.select("file", F.col("name").alias("word"), F.col("file").alias("at_file"), "name")
    far = imports.where("resolved_file is not null").select("file", F.col("local").alias("word"), F.col("resolved_file").alias("at_file"), "name").join(constants.select(F.col("file").alias("at_file"), "name"), ["at_file", "name"], "left_semi")
    hit = words.join(own.unionByName(far.select("file", "word", "at_file", "name")).distinct(), ["file", "word"])
    return _edges(hit, node("FUNCTION", file=F.col("at_file"), function=F.col("name")), "uses", "constant")


def fixture_edges(functions: DataFrame, parameters: DataFrame) -> DataFrame:
    """Tests and the fixtures that their parameters name: of the same file, else of the nearest conftest above, else the only one of that name."""
    tests = parameters.join(functions.where("is_test").select("file", F.col("name").alias("function"), "class", "is_test"), ["file", "function"]).select("file", "function", functions["class"], "is_test", F.col("name").alias("fixture"))
    have = functions.where("fixture is not null").select(F.col("fixture").alias("fixture"), F.col("file").alias("at_file"))
    folder = F.regexp_replace("at_file", "[^/]*$", "")
    above = F.endswith("at_file", F.lit("conftest.py")) & F.startswith("file", folder)
    many = F.count_distinct
    alone = have.groupBy("fixture").agg(many("at_file").alias("n"))
    hit = tests.join(have, "fixture").join(alone, "fixture").withColumn("rank", F.when(F.col("file") == F.col("at_file"), 0).when(above, 1000 - F.length(folder)).when(F.col("n") == 1, 2000))
    best = Window.partitionBy("file", "function", "class", "fixture").orderBy("rank", "at_file")
    chosen = hit.where("rank is not null").withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return _edges(chosen, node("FUNCTION", file=F.col("at_file"), function=F.col("fixture")), "convention", "fixture")


def alias_calls(calls: DataFrame, aliases: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls of a variable that holds a function of the same file; a variable that held several reaches all of them."""
    held = aliases.select("file", F.col("alias").alias("called"), F.col("original").alias("target")).distinct()
    known = functions.where("class is null").select("file", F.col("name").alias("target")).distinct()
    open_ = calls.where("resolved_file is null and object is null and owner_function is not null").select("file", F.col("owner_function").alias("function"), F.col("owner_class").alias("class"), "is_test", F.col("function").alias("called"))
    hit = open_.join(held, ["file", "called"]).join(known, ["file", "target"])
    return _edges(hit, node("FUNCTION", file=F.col("file"), function=F.col("target")), "candidates", "alias")


#: Places next to a line that a declaration may be reported at, the nearest first (fixed values).
NEAR_LINES = (0, 1, 2, -1, 3, -2)


def near_declarations(found: DataFrame, functions: DataFrame) -> DataFrame:
    """found (id, file, line) with the function that is declared there, or the nearest of the lines that NEAR_LINES allows: an equi-join on the tried lines, then the first try."""
    tries = F.array(*[F.struct(F.lit(k).alias("rank"), (F.col("line") + d).alias("start_line")) for k, d in enumerate(NEAR_LINES)])
    tried = found.select("id", "file", F.explode(tries).alias("t")).select("id", "file", "t.rank", "t.start_line")
    hit = tried.join(functions.select("file", "start_line", "name", "class"), ["file", "start_line"])
    best = hit.groupBy("id").agg(F.min_by(F.struct("name", "class", "start_line"), F.struct("rank", "name")).alias("d"))
    return found.join(best, "id", "left").select(*found.columns, "d.name", "d.class", "d.start_line")
