"""Impact queries over an execution graph whose edges carry node structs.

Edges: edge_id bigint, edge_type, src, dst (nodes.NODE), call_id, is_test boolean, confidence, observed boolean, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import confidence as C
from ..plans.closure import closure
from ..plans.nodes import node_key, node_residual

#: Edge types that a policy walks, and its depth. None: all, unbounded. LOCAL_EDIT walks nothing, NEW_FEATURE has a plan of its own.
POLICIES = {
    "DEFAULT": (None, None), "BUG_FIX": (None, None), "FEATURE_ADDITION": ("NEW_FEATURE", None), "LOCAL_EDIT": ((), 0),
    "DEPENDENCY_ONLY": (("IMPORT", "CONTRACT", "MODULE_DEPENDENCY"), 1), "SIGNATURE_CHANGE": (None, 1),
    "TAINT_FLOW": (("FUNCTION_CALL", "DB_ACCESS", "SECURITY_SINK", "TAINT_PROPAGATION"), None), "NEW_FEATURE": (None, None),
}


def filtered(edges: DataFrame, types=None, include_tests: bool = False, min_confidence: str | None = None) -> DataFrame:
    """The edges that a walk may use; done once, before the loop, so that Spark pushes it into the scan."""
    out = edges
    if types is not None:
        out = out.where(F.col("edge_type").isin(*types)) if types else out.where("false")
    if not include_tests:
        out = out.where(~F.coalesce("is_test", F.lit(False)))
    if min_confidence is not None:
        out = out.where(C.at_least(C.edge_confidence(F.col("confidence"), F.col("observed"), F.col("source")), min_confidence))
    return out


def _keyed(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src_key": node_key(F.col("src")), "dst_key": node_key(F.col("dst"))})


def _seeds(targets: DataFrame) -> DataFrame:
    return targets.select("seed_id", F.col("node"), node_key(F.col("node")).alias("key"))


def walk(edges: DataFrame, targets: DataFrame, direction: str, max_depth: int | None = None, types=None, include_tests: bool = False, min_confidence: str | None = None) -> DataFrame:
    """Edges upstream or downstream of the targets (seed_id, node): seed_id, depth and the edge's columns; one row an edge, at its least depth."""
    usable = _keyed(filtered(edges, types, include_tests, min_confidence))
    met = closure(usable, _seeds(targets), direction, max_depth, node_residual)
    return met.join(edges, "edge_id").select("seed_id", "depth", *edges.columns)


def upstream(edges, targets, **options) -> DataFrame:
    return walk(edges, targets, "up", **options)


def downstream(edges, targets, **options) -> DataFrame:
    return walk(edges, targets, "down", **options)


def resolve_impact(edges: DataFrame, targets: DataFrame, policy: str = "DEFAULT", max_depth: int | None = None, direction: str | None = None, types=None, include_tests: bool = False, min_confidence: str | None = None) -> DataFrame:
    """The edges that matter under a policy, with `direction` up or down. An unknown policy is DEFAULT; given types and depth go before the policy's, but a bounded policy stays bounded."""
    policy = policy if policy in POLICIES else "DEFAULT"
    if policy == "FEATURE_ADDITION":
        policy = "NEW_FEATURE"
    own_types, own_depth = POLICIES[policy]
    if policy == "NEW_FEATURE":
        return new_feature(edges, targets, types).withColumn("direction", F.lit("down"))
    if policy == "LOCAL_EDIT":
        return walk(edges, targets, "up", 0).withColumn("direction", F.lit("up"))
    options = {"types": types if types is not None else own_types, "max_depth": own_depth if own_depth is not None else max_depth, "include_tests": include_tests, "min_confidence": min_confidence}
    ways = {"UPSTREAM": ["up"], "DOWNSTREAM": ["down"]}.get((direction or "").upper(), ["up"] if policy == "SIGNATURE_CHANGE" else ["up", "down"])
    parts = [walk(edges, targets, way, **options).withColumn("direction", F.lit(way)) for way in ways]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def new_feature(edges: DataFrame, targets: DataFrame, types=None) -> DataFrame:
    """The slice of the nearest route: route -> handler -> service -> database.

    The nearest route is the one the fewest steps upstream of a target (of equally near ones the first by edge_id); a route is its own. Without one, the routes in
    the target's file are taken; and without these, the edges at the target. Confidence, tests and depth don't count here.
    """
    usable = filtered(edges, types, include_tests=True)
    met = closure(_keyed(usable), _seeds(targets), "up", None, node_residual, until=lambda n: n["type"] == "ROUTE").join(usable.select("edge_id", "src"), "edge_id").where("src.type = 'ROUTE'")
    nearest = met.groupBy("seed_id").agg(F.min_by("src", F.struct("depth", "edge_id")).alias("node"))
    own = targets.where("node.type = 'ROUTE'")
    routes = own.unionByName(nearest.join(own, "seed_id", "left_anti"))
    here = targets.join(routes, "seed_id", "left_anti").where("node.file is not null").select("seed_id", F.col("node.file").alias("file"))
    ends = usable.select(F.explode(F.array("src", "dst")).alias("node")).where("node.type = 'ROUTE'").distinct()
    beside = here.join(ends, ends["node"]["file"] == here["file"]).select("seed_id", "node").distinct()
    routes = routes.unionByName(beside)

    def hop(nodes: DataFrame, kind: str | None, depth: int) -> DataFrame:
        e = usable if kind is None else usable.where(F.col("edge_type") == kind)
        keyed = nodes.select("seed_id", F.col("node").alias("at"), node_key(F.col("node")).alias("key")).where("key is not null")
        hit = keyed.join(e.withColumn("key", node_key(F.col("src"))), "key").where(node_residual(F.col("at"), F.col("src")))
        return hit.select("seed_id", F.lit(depth).alias("depth"), *edges.columns).dropDuplicates(["seed_id", "edge_id"])

    first = hop(routes, None, 1)
    second = hop(first.where("dst.type = 'FUNCTION'").select("seed_id", F.col("dst").alias("node")).distinct(), "FUNCTION_CALL", 2)
    third = hop(second.select("seed_id", F.col("dst").alias("node")).distinct(), "DB_ACCESS", 3)
    lone = targets.join(routes, "seed_id", "left_anti").select("seed_id", F.col("node").alias("at"), node_key(F.col("node")).alias("key")).where("key is not null")
    at_end = lambda end: lone.join(usable.withColumn("key", node_key(F.col(end))), "key").where(node_residual(F.col("at"), F.col(end))).select("seed_id", F.lit(1).alias("depth"), *edges.columns)
    incident = at_end("src").unionByName(at_end("dst"))
    every = first.unionByName(second).unionByName(third).unionByName(incident)
    return every.withColumn("nth", F.row_number().over(_first_depth())).where("nth = 1").drop("nth")


def _first_depth():
    from pyspark.sql import Window

    return Window.partitionBy("seed_id", "edge_id").orderBy("depth")


def routes_by_model(edges: DataFrame, model: str) -> DataFrame:
    """Routes upstream of a database model."""
    from ..plans.nodes import node

    target = edges.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("seed_id"), node("DATABASE", model=model).alias("node"))
    return upstream(edges, target, include_tests=True).where("src.type = 'ROUTE'").select("depth", "src").distinct()


def neighbors(edges: DataFrame, targets: DataFrame, hops: int = 1, include_tests: bool = False, limit: int = 40) -> DataFrame:
    """Functions that call, or are called by, a target within up to three hops; one row for each (file, function, class), callers before callees, at the least depth."""
    hops = max(1, min(3, hops))
    up = upstream(edges, targets, max_depth=hops, types=("FUNCTION_CALL",), include_tests=include_tests).select("seed_id", "depth", F.col("src").alias("n"), F.lit("caller").alias("relation"))
    down = downstream(edges, targets, max_depth=hops, types=("FUNCTION_CALL",), include_tests=include_tests).select("seed_id", "depth", F.col("dst").alias("n"), F.lit("callee").alias("relation"))
    every = up.unionByName(down).groupBy("seed_id", "n.file", "n.function", "n.class").agg(F.min(F.struct("relation", "depth")).alias("best"))
    ordered = every.select("seed_id", "file", "function", "class", F.when(F.col("best.relation") == "callee", "callee").otherwise("caller").alias("relation"), F.col("best.depth").alias("depth"))
    return ordered.orderBy("depth", "relation", "file", "function").limit(limit)


def tests_for(edges: DataFrame, targets: DataFrame, test_files: DataFrame, hops: int = 3, limit: int | None = 30) -> DataFrame:
    """Functions in files of tests (column file) that reach a target within up to six hops, nearest first."""
    met = upstream(edges, targets, max_depth=max(1, min(6, hops)), types=("FUNCTION_CALL",), include_tests=True)
    callers = met.select("seed_id", "depth", "src.file", "src.function", "src.class").join(test_files.select("file").distinct(), "file", "left_semi")
    best = callers.groupBy("seed_id", "file", "function", "class").agg(F.min("depth").alias("depth"))
    return best if limit is None else best.orderBy("depth", "file", "function").limit(limit)


def file_dependents(imports: DataFrame, files: DataFrame, hops: int = 2, limit: int | None = 60) -> DataFrame:
    """Files that import a file, directly or through others, up to four hops: prod and test apart, each with its total and cut to `limit` after that.

    imports: file, resolved_file, is_test (imports and re-exports together). files: file.
    """
    from pyspark.sql import Window

    from ..plans.closure import reach

    links = imports.where("resolved_file is not null").groupBy(F.col("file").alias("src_key"), F.col("resolved_file").alias("dst_key")).agg(F.lit(1).alias("one"))
    numbered = links.select("src_key", "dst_key", F.xxhash64("src_key", "dst_key").alias("edge_id"))
    found = reach(numbered, files.select(F.col("file").alias("seed_id"), F.col("file").alias("key")), "up", max(1, min(4, hops))).where("depth > 0 and key <> seed_id")
    kinds = imports.groupBy(F.col("file").alias("key")).agg(F.coalesce(F.max("is_test"), F.lit(False)).alias("is_test"))
    both = found.join(kinds, "key", "left").select("seed_id", F.col("key").alias("file"), "depth", F.coalesce("is_test", F.lit(False)).alias("is_test"))
    part = Window.partitionBy("seed_id", "is_test")
    ranked = both.withColumns({"total": F.count("*").over(part), "nth": F.row_number().over(part.orderBy("depth", "file"))})
    return (ranked if limit is None else ranked.where(F.col("nth") <= limit)).select("seed_id", "is_test", "depth", "file", "total")


def completeness(calls: DataFrame, targets: DataFrame, examples: int = 10) -> DataFrame:
    """Whether calls that could not be resolved might reach a target by its name: counts, the first examples, and a verdict.

    calls: file, function, resolved_file, external boolean. targets: seed_id, name. `unknown`: unresolved calls of the name; `partial`: external ones only; else `complete`.
    """
    named = calls.select(F.col("function").alias("name"), "file", "resolved_file", F.coalesce("external", F.lit(False)).alias("external"))
    hit = targets.join(named, "name", "left")
    lost = F.col("file").isNotNull() & F.col("resolved_file").isNull() & ~F.col("external")
    out = F.col("file").isNotNull() & F.col("external")
    from pyspark.sql import Window

    counts = hit.groupBy("seed_id", "name").agg(F.count(F.when(lost, 1)).alias("unresolved"), F.count(F.when(out, 1)).alias("external"))
    nth = F.row_number().over(Window.partitionBy("seed_id", "name").orderBy("file"))
    some = hit.where(lost).select("seed_id", "name", "file").distinct().withColumn("nth", nth).where(F.col("nth") <= examples).groupBy("seed_id", "name").agg(F.sort_array(F.collect_list("file")).alias("examples"))
    grouped = counts.join(some, ["seed_id", "name"], "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    return grouped.withColumn("verdict", F.when(F.col("unresolved") > 0, "unknown").when(F.col("external") > 0, "partial").otherwise("complete"))


def confidence_histogram(edges: DataFrame) -> DataFrame:
    label = C.edge_confidence(F.col("confidence"), F.col("observed"), F.col("source"))
    return edges.groupBy(label.alias("confidence")).agg(F.count("*").alias("n")).withColumn("rank", C.rank(F.col("confidence"))).orderBy(F.desc("rank"), "confidence")


def graph_metrics(**tables: DataFrame) -> DataFrame:
    """Number of rows of each section, in one pass over a union of narrow counts."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n") for name, df in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def taint_findings(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Sinks that functions reachable from a tainted function write to. sources: seed_id, node; sinks: sink_id, node. Multi-source: one closure for all.

    Functions match exactly on (type, file, function) here: a class or line doesn't count.
    """
    def bare(n: Column) -> Column:
        return F.concat_ws("\x1f", n["type"], F.coalesce(n["file"], F.lit("~")), F.coalesce(n["function"], F.lit("~")))

    calls = edges.where("edge_type = 'FUNCTION_CALL'").select("edge_id", bare(F.col("src")).alias("src_key"), bare(F.col("dst")).alias("dst_key"))
    from ..plans.closure import reach

    reached = reach(calls, sources.select("seed_id", bare(F.col("node")).alias("key")), "down")
    return reached.join(sinks.select("sink_id", bare(F.col("node")).alias("key")), "key").select("seed_id", "sink_id", "depth", F.lit("TAINT_FLOW").alias("type"), F.lit("HIGH").alias("severity"))
