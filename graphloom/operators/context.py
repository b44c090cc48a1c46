"""The smallest useful context of a change: code of the functions a walk meets, chains, routes, taint; and views of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_slice, tokens
from .impact import resolve_impact


def visited(impact: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes of an impact's edges and the targets: seed_id, node, least depth."""
    ends = impact.select("seed_id", "depth", F.explode(F.array("src", "dst")).alias("node")).unionByName(targets.select("seed_id", F.lit(0).alias("depth"), "node"))
    return ends.groupBy("seed_id", "node").agg(F.min("depth").alias("depth"))


def snippets(nodes: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """Code of the functions among the nodes, one row for each (seed, file, function, class): seed_id, file, function, class, depth, code. A node without class fits any class."""
    f = functions.select("file", F.col("name").alias("function"), F.col("class").alias("f_class"), "start_line", "end_line")
    wanted = nodes.where("node.type in ('FUNCTION', 'MIDDLEWARE')").select("seed_id", "depth", "node.file", "node.function", F.col("node.class").alias("n_class"))
    hit = wanted.join(f, ["file", "function"]).where(F.col("n_class").isNull() | F.col("f_class").isNull() | (F.col("n_class") == F.col("f_class")))
    code = hit.join(files.select("file", "content"), "file").withColumn("code", line_slice(F.col("content"), F.col("start_line"), F.col("end_line")))
    best = Window.partitionBy("seed_id", "file", "function", "code").orderBy("depth")
    return code.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("seed_id", "file", "function", F.col("f_class").alias("class"), "depth", "start_line", "end_line", "code")


def chains(impact: DataFrame) -> DataFrame:
    """Edges as text, in the order of their depth: seed_id, depth, direction, chain."""
    full = lambda c: F.when(F.col(f"{c}.function").isNotNull(), F.concat_ws(".", f"{c}.class", f"{c}.function")).when(F.col(f"{c}.route").isNotNull(), F.concat_ws(" ", f"{c}.method", f"{c}.route")).otherwise(F.col(f"{c}.model"))
    return impact.select("seed_id", "depth", "direction", F.concat_ws(" -> ", full("src"), full("dst")).alias("chain")).distinct()


def assemble(edges: DataFrame, targets: DataFrame, functions: DataFrame, files: DataFrame, taint: DataFrame | None = None, policy: str = "DEFAULT", **options) -> DataFrame:
    """One row a target: snippets (nearest first), chains, files, taint findings of the visited functions, and the size of the context against all files.

    Targets are unions: of several the snippets are kept once each, by (file, function, code).
    """
    impact = resolve_impact(edges, targets, policy, **options)
    nodes = visited(impact, targets)
    code = snippets(nodes, functions, files)
    by_seed = code.groupBy("seed_id").agg(F.sort_array(F.collect_list(F.struct("depth", "file", "function", "class", "code"))).alias("snippets"), F.sort_array(F.collect_set("file")).alias("files"), F.sum(F.length("code")).alias("context_chars"), F.sum(tokens(F.col("code"))).alias("context_tokens"))
    paths = chains(impact).groupBy("seed_id").agg(F.sort_array(F.collect_set(F.struct("depth", "direction", "chain"))).alias("chains"))
    whole = files.agg(F.sum(F.length("content")).alias("repo_chars"), F.count("*").alias("repo_files"))
    out = targets.select("seed_id").distinct().join(by_seed, "seed_id", "left").join(paths, "seed_id", "left").crossJoin(F.broadcast(whole))
    if taint is not None:
        found = nodes.join(taint.withColumnRenamed("file", "t_file"), (F.col("node.function") == F.col("target_function")) & (F.col("node.file") == F.col("t_file"))).groupBy("seed_id").agg(F.collect_set(F.struct("type", "severity", "source", "sink", "model", "target_function")).alias("taint"))
        out = out.join(found, "seed_id", "left")
    return out.withColumn("percent_less", F.when(F.col("repo_chars") > 0, F.round((1 - F.coalesce("context_chars", F.lit(0)) / F.col("repo_chars")) * 100, 2)).otherwise(0.0))


def signature(files: DataFrame, functions: DataFrame, file: str, name: str) -> DataFrame:
    """The whole body of a function."""
    f = functions.where((F.col("file") == file) & (F.col("name") == name))
    return f.join(files.select("file", "content"), "file").select("file", "name", "class", line_slice(F.col("content"), F.col("start_line"), F.col("end_line")).alias("code"))


def function_facts(graph, file: str, function: str) -> dict[str, DataFrame]:
    """Calls, routes, returns, tainted and sanitized variables, and what is called, of one function."""
    here = lambda df, f="function": df.where((F.col("file") == file) & (F.col(f) == function))
    states = here(graph.variable_states)
    return {
        "calls": here(graph.calls, "owner_function"), "routes": graph.routes.where((F.col("file") == file) & (F.element_at(F.split("handler", r"\."), -1) == function)), "returns": here(graph.returns),
        "tainted": states.where("tainted").select("variable").distinct(), "sanitized": states.where("sanitized").select("variable").distinct(),
        "downstream": here(graph.calls, "owner_function").where("resolved_file is not null").select("resolved_file", "resolved_name", "resolved_class").distinct(),
    }


def unknown_symbols(graph, patches: DataFrame) -> DataFrame:
    """Identifiers of patches (file, function, identifiers) that are no function, parameter, variable, import or builtin known in the file."""
    from .build import BUILTINS

    known = graph.functions.select("file", F.col("name").alias("symbol"))
    for df, c in ((graph.parameters, "name"), (graph.variable_states, "variable"), (graph.imports, "local"), (graph.classes, "class")):
        known = known.unionByName(df.select("file", F.col(c).alias("symbol")))
    used = patches.select("file", "function", F.explode("identifiers").alias("symbol")).where(~F.col("symbol").isin(*BUILTINS))
    return used.join(known.distinct(), ["file", "symbol"], "left_anti")


def symbol_kinds(graph, asked: DataFrame) -> DataFrame:
    """What a symbol of a function is, if anything: keyword or builtin, function, parameter, local, import or sanitized variable. asked: file, function, symbol; returns it with `kinds` (sorted) and `exists`."""
    from .build import BUILTINS
    from .scoring import KEYWORDS

    def known(df: DataFrame, name: str, kind: str, scoped: bool) -> DataFrame:
        return df.select("file", F.col("function") if scoped else F.lit(None).cast("string").alias("function"), F.col(name).alias("symbol"), F.lit(kind).alias("kind"))

    every = known(graph.functions, "name", "function", False).unionByName(known(graph.imports, "local", "import", False)).unionByName(known(graph.classes, "class", "class", False))
    every = every.unionByName(known(graph.parameters, "name", "parameter", True)).unionByName(known(graph.variable_states, "variable", "local", True)).unionByName(known(graph.variable_states.where("sanitized"), "variable", "sanitized", True)).distinct()
    k = every.select("file", F.col("function").alias("in_function"), "symbol", "kind")
    hit = asked.join(k, ["file", "symbol"], "left").where(F.col("kind").isNull() | F.col("in_function").isNull() | (F.col("in_function") == F.col("function")))
    grouped = asked.join(hit.groupBy("file", "function", "symbol").agg(F.sort_array(F.collect_set("kind")).alias("kinds")), ["file", "function", "symbol"], "left")
    word = F.when(F.lower("symbol").isin(*KEYWORDS) | F.col("symbol").isin(*BUILTINS), F.array(F.lit("builtin"))).otherwise(F.array().cast("array<string>"))
    out = grouped.withColumn("kinds", F.sort_array(F.array_union(F.coalesce("kinds", F.array().cast("array<string>")), word)))
    return out.withColumn("exists", F.size("kinds") > 0)
