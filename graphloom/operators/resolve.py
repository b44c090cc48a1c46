"""Name, type and call lookups of the resolution pipeline, as joins over symbol tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.closure import reach

#: Most route templates with an open end that are sent to every task.
BROADCAST = 10_000


def resolve_alias(uses: DataFrame, aliases: DataFrame) -> DataFrame:
    """uses (file, scope, name) with `original`: the alias of the scope, else the file's GLOBAL one, else the name itself. aliases: file, scope, alias, original."""
    own = aliases.select("file", "scope", F.col("alias").alias("name"), F.col("original").alias("__own"))
    shared = aliases.where("scope = 'GLOBAL'").select("file", F.col("alias").alias("name"), F.col("original").alias("__shared"))
    return uses.join(own, ["file", "scope", "name"], "left").join(shared, ["file", "name"], "left").select(*uses.columns, F.coalesce("__own", "__shared", "name").alias("original"))


def resolve_type(uses: DataFrame, types: DataFrame, parents: DataFrame, hops: int = 12) -> DataFrame:
    """uses (file, scope, variable) with `type` from the nearest enclosing scope that has one, up to `hops`, then GLOBAL. types: file, scope, variable, type; parents: file, scope, parent.

    The chain of every scope in use is expanded once; then it is one join and a min_by of the distance.
    """
    key = lambda c: F.concat_ws("\x1f", "file", c)
    links = parents.select(key("scope").alias("src_key"), key("parent").alias("dst_key")).distinct().withColumn("edge_id", F.xxhash64("src_key", "dst_key"))
    starts = uses.select(key("scope").alias("seed_id"), key("scope").alias("key")).distinct()
    chain = reach(links, starts, "down", hops)
    known = types.select(key("scope").alias("key"), "variable", "type")
    wanted = uses.select("file", "scope", "variable").distinct().withColumn("seed_id", key("scope"))
    found = wanted.join(chain, "seed_id").join(known, ["key", "variable"]).groupBy("file", "scope", "variable").agg(F.min_by("type", F.struct("depth", "type")).alias("__t"))
    shared = types.where("scope = 'GLOBAL'").select("file", "variable", F.col("type").alias("__g"))
    return uses.join(found, ["file", "scope", "variable"], "left").join(shared, ["file", "variable"], "left").select(*uses.columns, F.coalesce("__t", "__g").alias("type"))


def resolve_destructured(uses: DataFrame, destructured: DataFrame) -> DataFrame:
    """uses (file, name) with source_object and original: what a destructuring took the local name from, null if none did; of several the last. destructured: file, local, source, function, seq."""
    last = destructured.groupBy("file", F.col("local").alias("name")).agg(F.max_by(F.struct("source", "function"), "seq").alias("__d"))
    return uses.join(last, ["file", "name"], "left").select(*uses.columns, F.col("__d.source").alias("source_object"), F.col("__d.function").alias("original"))


def resolve_static(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """uses (file, class, method, want_static) with start_line: the first definition that is static as wanted, else the first of all. defs: file, class, method, static, start_line, seq."""
    own = defs.groupBy("file", "class", "method").agg(*[F.min_by(F.when(F.coalesce("static", F.lit(False)) == flag, F.col("start_line")), F.when(F.coalesce("static", F.lit(False)) == flag, F.col("seq"))).alias(name) for flag, name in ((True, "__s"), (False, "__i"))])
    wanted = F.coalesce("want_static", F.lit(False))
    return uses.join(own, ["file", "class", "method"], "left").select(*uses.columns, F.when(wanted, F.coalesce("__s", "__i")).otherwise(F.coalesce("__i", "__s")).alias("start_line"))


def callable_targets(refs: DataFrame, methods: DataFrame, functions: DataFrame, imports: DataFrame, stars: DataFrame) -> DataFrame:
    """refs (ref_id, file, class, ref) with target_file, target_name, target_class: the function that a reference names, without calling it.

    `self.f` is a method of the own class, `Cls.f` of that class, `mod.f` a function of what `mod` imports; a bare name is a function of the file, else of what it imports, else of a
    star import, in their order. methods: class, name, file (found up the chain already, one row each); functions: file, name, kind; imports: file, local, resolved_file, exported;
    stars: file, source_file, pos. Each way is an equi-join; the first that finds something wins.
    """
    bare = refs.where(~F.contains("ref", F.lit("("))).select("ref_id", "file", F.col("class").alias("own"), F.regexp_extract("ref", r"^(.*)\.[^.]*$", 1).alias("head"), F.regexp_extract("ref", r"([^.]*)$", 1).alias("name"))
    inner = F.col("head").isin("self", "this", "cls") & F.col("own").isNotNull()
    owner = F.when(inner, F.col("own")).when(F.col("head").rlike("^[A-Z]"), F.col("head"))
    where = lambda n, df: df.select("ref_id", F.lit(n).alias("way"), F.col("target_file"), F.col("target_name"), F.col("target_class"))
    of_class = bare.withColumn("target_class", owner).join(methods.select(F.col("class").alias("target_class"), "name", F.col("file").alias("target_file")), ["target_class", "name"]).withColumn("target_name", F.col("name"))
    plain = functions.where("kind is null or kind <> 'class'").select(F.col("file").alias("target_file"), F.col("name").alias("target_name")).distinct()
    none = F.lit(None).cast("string")
    imp = imports.select("file", F.col("local"), F.col("resolved_file").alias("target_file"), "exported")
    through = bare.where(owner.isNull() & (F.col("head") != "")).join(imp.withColumnRenamed("local", "head"), ["file", "head"]).withColumn("target_name", F.col("name")).join(plain, ["target_file", "target_name"], "left_semi").withColumn("target_class", none)
    alone = bare.where("head = ''")
    here = alone.select("ref_id", F.col("file").alias("target_file"), F.col("name").alias("target_name")).join(plain, ["target_file", "target_name"], "left_semi").withColumn("target_class", none)
    named = alone.join(imp.withColumnRenamed("local", "name"), ["file", "name"]).withColumn("target_name", F.coalesce("exported", "name")).join(plain, ["target_file", "target_name"], "left_semi").withColumn("target_class", none)
    starred = alone.join(stars, "file").select("ref_id", "pos", F.col("source_file").alias("target_file"), F.col("name").alias("target_name")).join(plain, ["target_file", "target_name"], "left_semi").withColumn("target_class", none)
    tries = where(0, of_class).unionByName(where(1, through)).unionByName(where(2, here)).unionByName(where(3, named)).unionByName(starred.select("ref_id", (F.col("pos") + 4).alias("way"), "target_file", "target_name", "target_class"))
    best = tries.groupBy("ref_id").agg(F.min_by(F.struct("target_file", "target_name", "target_class"), F.struct("way", "target_file")).alias("__t"))
    return refs.join(best, "ref_id", "left").select(*refs.columns, "__t.*")


def marker_calls(calls: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Targets of calls of a name whose inferred type says what it holds: stored functions, stored classes (their constructors), or an instance (its `__call__`).

    calls: call_id, kind (callable, class or instance), in_file (of callables), names array. functions: file, name, class; classes: class, file. Returns call_id, file, name, class, constructor,
    resolution (`typed` for one target, `candidates` for more).
    """
    each = calls.select("call_id", "kind", "in_file", F.posexplode("names").alias("pos", "wanted"))
    stored = each.where("kind = 'callable'").join(functions, (F.col("in_file") == F.col("file")) & (F.col("wanted") == F.col("name"))).select("call_id", "pos", "file", "name", "class", F.lit(False).alias("constructor"))
    made = each.where("kind = 'class'").join(classes.withColumnRenamed("class", "wanted"), "wanted").select("call_id", "pos", "file", F.col("wanted").alias("name"), F.lit(None).cast("string").alias("class"), F.lit(True).alias("constructor"))
    called = each.where("kind = 'instance'").join(functions.where("name = '__call__'"), F.col("wanted") == F.col("class")).select("call_id", "pos", "file", "name", "class", F.lit(False).alias("constructor"))
    every = stored.unionByName(made).unionByName(called)
    many = F.count("*").over(Window.partitionBy("call_id"))
    return every.withColumn("resolution", F.when(many == 1, "typed").otherwise("candidates")).drop("pos")


def last_wins(functions: DataFrame) -> DataFrame:
    """The current definition of each (file, name): the last registered, but a function of the module is not shadowed by a method. Needs seq."""
    rank = Window.partitionBy("file", "name").orderBy(F.coalesce(F.col("class"), F.lit("")) != "", F.desc("seq"))
    return functions.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")


def unique_owner(candidates: DataFrame, name: str = "name") -> DataFrame:
    """name, file of names that one class only owns; of several files one outside bundles, then one under /src/, then the first. candidates: name, class, file, is_bundle."""
    one = candidates.groupBy(name).agg(F.count_distinct("class").alias("n"), F.min_by("file", F.struct("is_bundle", ~F.contains("file", F.lit("/src/")), "file")).alias("file"), F.min("class").alias("class"))
    return one.where("n = 1").drop("n")


def through_reexports(uses: DataFrame, reexports: DataFrame, defined: DataFrame, depth: int = 6) -> DataFrame:
    """uses (file, name) with target_file, target_name: what a chain of re-exports leads to, named ones before stars, at most `depth` steps; the place itself if it defines the name.

    reexports: file, exported (null for a star), source_file, original, is_star, pos. defined: file, name.
    """
    from ..plans.lineage import cut

    start = uses.select("file", "name").distinct()
    now = start.select("file", "name", F.col("file").alias("at_file"), F.col("name").alias("at_name"), F.array().cast("array<string>").alias("order"))
    have = defined.select(F.col("file").alias("at_file"), F.col("name").alias("at_name")).distinct()
    done = None
    for step in range(depth + 1):
        hit = now.join(have, ["at_file", "at_name"], "left_semi").withColumn("steps", F.lit(step))
        done = hit if done is None else done.unionByName(hit)
        if step == depth:
            break
        rest = now.join(have, ["at_file", "at_name"], "left_anti")
        r = reexports.select(F.col("file").alias("at_file"), "exported", "source_file", "original", "is_star", "pos")
        moved = rest.join(r, "at_file").where((F.col("exported") == F.col("at_name")) | F.col("is_star"))
        now = cut(moved.select("file", "name", F.col("source_file").alias("at_file"), F.when(F.col("is_star"), F.col("at_name")).otherwise(F.coalesce("original", "at_name")).alias("at_name"), F.concat("order", F.array(F.concat(F.when(F.col("is_star"), "1:").otherwise("0:"), F.lpad(F.col("pos").cast("string"), 8, "0")))).alias("order")))
    best = done.groupBy("file", "name").agg(F.min_by(F.struct("at_file", "at_name"), F.struct("order")).alias("__to"))
    return uses.join(best, ["file", "name"], "left").select(*uses.columns, F.col("__to.at_file").alias("target_file"), F.col("__to.at_name").alias("target_name"))


def up_the_classes(uses: DataFrame, classes: DataFrame, methods: DataFrame, depth: int = 8) -> DataFrame:
    """uses (class, method) with owner, file: the nearest class from `class` upwards that has the method. classes: class, superclass; methods: class, method, file."""
    links = classes.where("superclass is not null").select(F.col("class").alias("src_key"), F.col("superclass").alias("dst_key")).distinct().withColumn("edge_id", F.xxhash64("src_key", "dst_key"))
    starts = uses.select(F.col("class").alias("seed_id"), F.col("class").alias("key")).distinct()
    chain = reach(links, starts, "down", depth)
    have = methods.select(F.col("class").alias("key"), "method", "file")
    hit = uses.select(F.col("class").alias("seed_id"), "method").distinct().join(chain, "seed_id").join(have, ["key", "method"])
    best = hit.groupBy(F.col("seed_id").alias("class"), "method").agg(F.min_by(F.struct(F.col("key").alias("owner"), "file"), F.struct("depth", "key", "file")).alias("__m"))
    return uses.join(best, ["class", "method"], "left").select(*uses.columns, "__m.owner", "__m.file")


def argument_flow(arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """Which argument lands in which parameter. arguments: call_id, function, pos, value; parameters: function, pos, group_type (positional, rest, destructured), name, keys.

    Positional ones meet at equal places; a rest parameter takes every place from its own on (range join within the function); a destructured one takes, by name, the keys that an object literal has.
    """
    plain = arguments.join(parameters.where("group_type = 'positional'"), ["function", "pos"]).select("call_id", "function", "pos", "value", F.col("name").alias("parameter"), F.lit("positional").alias("kind"))
    rest = parameters.where("group_type = 'rest'").select("function", F.col("pos").alias("from_pos"), "name")
    spread = arguments.join(rest, "function").where("pos >= from_pos").select("call_id", "function", "pos", "value", F.col("name").alias("parameter"), F.lit("rest").alias("kind"))
    keyed = parameters.where("group_type = 'destructured'").select("function", "pos", F.explode("keys").alias("key"))
    pairs = arguments.withColumn("pair", F.explode(F.regexp_extract_all("value", F.lit(r"([A-Za-z_$][\w$]*\s*(?::\s*[^,{}]+)?)(?=[,}])"), 1))).where(F.startswith("value", F.lit("{")))
    named = pairs.withColumns({"key": F.trim(F.split("pair", ":")[0]), "given": F.trim(F.coalesce(F.try_element_at(F.split("pair", ":"), F.lit(2)), F.col("pair")))})
    taken = named.join(keyed, ["function", "pos", "key"]).select("call_id", "function", "pos", F.col("given").alias("value"), F.col("key").alias("parameter"), F.lit("destructured").alias("kind"))
    return plain.unionByName(spread).unionByName(taken)


def route_matches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes whose template fits a called path, those with the fewest wildcards of each call. calls: call_id, method, path; routes: route_id, method (ANY fits all), template.

    `{v}` and `*` stand for one segment, `**` for any rest. A template without `**` is met by the number of segments and the first segment, where that is literal; else by the number alone. The pattern is the
    residual. Templates with `**` are sent to the calls while they are at most BROADCAST, else they are met by their first segment.
    """
    segments = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    wild = r"\{[^/}]*\}|\*"
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("template", r"([.+()\[\]^$|\\?])", r"\\$1"), r"\*\*", "\u0001"), wild, "[^/]+"), "\u0001", ".*")
    head = F.get(segments("template"), F.lit(0))
    t = routes.select("route_id", F.upper("method").alias("route_method"), "template", F.concat(F.lit("^"), pattern, F.lit("/?$")).alias("pattern"), F.size(F.regexp_extract_all("template", F.lit(wild), 0)).alias("wildcards"), F.size(segments("template")).alias("segments"), F.when(~head.rlike(r"[{*]"), head).alias("first"), F.contains("template", F.lit("**")).alias("open"))
    c = calls.withColumns({"segments": F.size(segments("path")), "first": F.get(segments("path"), F.lit(0))})
    fits = F.expr("path rlike pattern") & ((F.col("route_method") == "ANY") | (F.col("route_method") == F.upper("method")))
    cols = ["call_id", "route_id", "template", "wildcards"]
    literal = c.join(t.where("not open and first is not null"), ["segments", "first"]).where(fits).select(*cols)
    other = c.drop("first").join(t.where("not open and first is null").drop("first"), "segments").where(fits).select(*cols)
    rest = t.where("open").drop("segments")
    if rest.count() <= BROADCAST:
        open_ended = c.drop("segments", "first").join(F.broadcast(rest.drop("first")), fits).select(*cols)
    else:
        by_head = c.drop("segments").join(rest.where("first is not null"), "first").where(fits).select(*cols)
        open_ended = by_head.unionByName(c.drop("segments", "first").join(rest.where("first is null").drop("first"), fits).select(*cols))
    best = Window.partitionBy("call_id").orderBy("wildcards")
    return literal.unionByName(other).unionByName(open_ended).withColumn("__r", F.rank().over(best)).where("__r = 1").drop("__r")


def infer_unique(facts: DataFrame, subject: list[str], value: str) -> DataFrame:
    """subject, value where all facts agree; candidates (sorted) where they don't."""
    sets = facts.where(F.col(value).isNotNull()).groupBy(*subject).agg(F.sort_array(F.collect_set(value)).alias("candidates"))
    return sets.select(*subject, F.when(F.size("candidates") == 1, F.col("candidates")[0]).alias(value), F.when(F.size("candidates") > 1, F.col("candidates")).alias("candidates"))


def propagate_types(known: DataFrame, flows: DataFrame, rounds: int = 6) -> DataFrame:
    """Types that flow along edges until nothing changes, at most `rounds` rounds. known: item, type, fixed; flows: src, dst. An item whose sources agree on one type gets it; a declared one keeps its own.

    Each round is a join and an aggregate over the whole state, checkpointed; it ends when the number of typed items stays the same.
    """
    from ..plans.lineage import cut

    state = cut(known.select("item", "type", F.lit(0).alias("round")))
    n = state.count()
    for step in range(1, rounds + 1):
        offered = flows.join(state, flows["src"] == state["item"]).select(F.col("dst").alias("item"), "type")
        agreed = offered.groupBy("item").agg(F.min("type").alias("low"), F.max("type").alias("high")).where("low = high").select("item", F.col("low").alias("type"), F.lit(step).alias("round"))
        state = cut(state.unionByName(agreed.join(state, "item", "left_anti")))
        if (more := state.count()) == n:
            break
        n = more
    return state
