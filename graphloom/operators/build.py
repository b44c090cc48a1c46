"""From matches to the graph's sections: declarations, resolution of modules and calls, inference, linking, taint.

All tables are DataFrames; the order that an imperative builder would need is the dependency between them, and the bounded fixpoint is a loop of joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.nodes import node, normal_path
from ..plans.priority import first_match
from . import link as L
from . import registry as K
from . import resolve as R

# Builtin functions and methods that calls often mean, markers of untrusted input, sanitizers, endings that a module path may lack.
BUILTINS = set("abs all any bool bytes callable chr dict dir enumerate filter float format frozenset getattr hasattr hash id input int isinstance issubclass iter len list map max min next object open ord pow print range repr reversed round set setattr sorted str sum super tuple type vars zip require parseInt parseFloat String Number Boolean Array Object Promise setTimeout setInterval fetch isNaN Exception AssertionError AttributeError IndexError KeyError LookupError NotImplementedError OSError RuntimeError StopIteration TypeError ValueError Error RangeError".split())
BUILTIN_METHODS = set("append extend pop keys values items get update join split strip lower upper replace format startswith endswith encode decode sort add remove push slice map filter forEach reduce then catch log error includes indexOf toString trim".split())
UNTRUSTED = r"req(uest)?\.(body|query|params|args|form|json|headers|cookies)|\binput\("
SANITIZERS = r"\b(sanitize|escape|validate|clean|purify|parseInt|encodeURIComponent|quote)\w*\b"
ENDINGS = (".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", ".java", ".py")


@dataclass
class Graph:
    """Sections by name, as attributes."""

    sections: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["sections"][name]
        except KeyError:
            raise AttributeError(name) from None


def _one(name: str) -> Column:
    return F.try_element_at(F.col("captures"), F.lit(name))[0]


def _many(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("captures"), F.lit(name)), F.array().cast("array<string>"))


def _of(matches: DataFrame, kind: str) -> DataFrame:
    return matches.where(F.col("match_type") == kind)


def declarations(matches: DataFrame) -> dict[str, DataFrame]:
    """Sections that need nothing but matches."""
    owner = ["owner_function", "owner_class"]
    flag = lambda c: F.coalesce(_one(c) == "true", F.lit(False))
    functions = _of(matches, "FUNCTION_DEF").select("file", _one("name").alias("name"), F.when(flag("is_method"), F.col("owner_class")).alias("class"), "start_line", "end_line", flag("static").alias("static"), _one("fixture").alias("fixture"), _one("parent").alias("parent"), _one("return_type").alias("return_type"), "is_test", flag("is_async").alias("is_async"), _many("decorators").alias("decorators"), "seq")
    classes = _of(matches, "CLASS_DEF").select("file", _one("name").alias("class"), _one("superclass").alias("superclass"), _many("interfaces").alias("interfaces"), flag("is_interface").alias("is_interface"), _many("fields").alias("fields"), _many("attrs").alias("attrs"), "seq")
    return {
        "functions": functions,
        "classes": classes,
        "imports": _of(matches, "IMPORT").select("file", _one("source").alias("source"), _one("name").alias("name"), _one("local").alias("local"), F.coalesce(_one("star") == "star", F.lit(False)).alias("is_star"), "is_test", "seq"),
        "reexports": _of(matches, "REEXPORT").select("file", F.when(_one("star").isNull(), _one("exported")).alias("exported"), _one("source").alias("source"), _one("original").alias("original"), F.coalesce(_one("star") == "star", F.lit(False)).alias("is_star"), F.col("seq").alias("pos")),
        "calls": _of(matches, "CALL").select("file", _one("call_id").alias("call_id"), _one("receiver").alias("object"), _one("name").alias("function"), *owner, F.col("owner_line").alias("caller_line"), "start_line", "is_test", flag("implicit").alias("implicit"), _one("dispatch").alias("dispatch"), _one("key").alias("dispatch_key")).where("call_id is not null"),
        "arguments": _of(matches, "ARGUMENT").select("file", _one("call_id").alias("call_id"), _one("function").alias("function"), _one("pos").cast("int").alias("pos"), _one("keyword").alias("keyword"), _one("value").alias("value"), *owner),
        "parameters": _of(matches, "PARAMETER").select("file", F.col("owner_function").alias("function"), F.col("owner_class").alias("class"), F.col("owner_line").alias("line"), _one("pos").cast("int").alias("pos"), _one("group").alias("group_type"), _one("name").alias("name"), _many("keys").alias("keys"), _one("type").alias("type")),
        "returns": _of(matches, "RETURN_VALUE").select("file", F.col("owner_function").alias("function"), F.col("owner_class").alias("class"), _one("value").alias("value"), _one("from_call").alias("from_call")),
        "types": _of(matches, "VARIABLE_TYPE").select("file", F.col("scope_id").alias("scope"), "owner_function", "owner_class", _one("variable").alias("variable"), _one("type").alias("type"), _one("from_call").alias("from_call")),
        "destructured": _of(matches, "DESTRUCTURE").select("file", _one("local").alias("local"), _one("source").alias("source"), _one("function").alias("function"), "seq"),
        "aliases": _of(matches, "ALIAS").select("file", F.col("scope_id").alias("scope"), _one("alias").alias("alias"), _one("original").alias("original")),
        "variable_states": _of(matches, "VARIABLE_STATE").select("file", F.col("owner_function").alias("function"), F.col("owner_class").alias("class"), _one("variable").alias("variable"), _one("value").alias("value"), (_one("value").rlike(UNTRUSTED) & ~_one("value").rlike(SANITIZERS)).alias("tainted"), _one("value").rlike(SANITIZERS).alias("sanitized")),
        "routes": _of(matches, "ROUTE").select("file", _one("method").alias("method"), _one("path").alias("path"), _one("router").alias("router"), _one("handler").alias("handler"), _many("middlewares").alias("middlewares")),
        "database_ops": _of(matches, "DATABASE_OP").select("file", _one("model").alias("model"), _one("operation").alias("operation"), _one("query").alias("query"), _one("connection").alias("connection"), F.col("owner_function").alias("function"), F.col("owner_class").alias("class")),
        "errors": _of(matches, "ERROR").select("file", F.col("owner_function").alias("function"), _one("throw").alias("throw")),
        "literals": _of(matches, "LITERAL").select("file", F.col("seq").alias("pos"), _one("text").alias("text")),
        "http_calls": _of(matches, "HTTP_CALL").select("file", F.col("owner_function").alias("function"), _one("method").alias("method"), _one("path").alias("path")),
        "constants": _of(matches, "CONSTANT").select("file", F.col("owner_class").alias("class"), _one("name").alias("name"), _one("kind").alias("kind"), _one("value").alias("value"), _many("targets").alias("targets")),
    }


def resolve_modules(imports: DataFrame, files: DataFrame, key: str = "source") -> DataFrame:
    """imports with resolved_file: the first existing of the ordered candidates of a relative, rooted or dotted module name, else null (external)."""
    folder = F.nullif(F.regexp_replace("file", "/?[^/]*$", ""), F.lit(""))
    src = F.col(key)
    relative = F.startswith(src, F.lit("./")) | F.startswith(src, F.lit("../"))
    joined = normal_path(F.concat_ws("/", folder, src))
    swapped = F.regexp_replace(joined, r"\.js$", ".ts")
    script = F.array(joined, swapped, *[F.concat(joined, F.lit(e)) for e in ENDINGS[:6]], *[F.concat(joined, F.lit("/index" + e)) for e in ENDINGS[:6]])
    dots = F.length(F.regexp_extract(src, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(src, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = normal_path(F.concat_ws("/", folder, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)).cast("int"))))
    member = F.when(~F.col("name").isin("*", "*module*"), F.col("name"))
    roots = F.when(dots > 0, F.array(up)).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda n: F.array_join(F.slice(F.split("file", "/"), 1, n - 1), "/")), F.array(F.lit("src"), F.lit("lib"))))
    in_root = lambda r, tail: normal_path(F.concat_ws("/", F.nullif(r, F.lit("")), F.nullif(tail, F.lit(""))))
    dotted = F.flatten(F.transform(roots, lambda r: F.array(in_root(r, F.concat_ws("/", rest, F.concat(member, F.lit(".py")))), in_root(r, F.concat_ws("/", rest, F.concat(member, F.lit("/__init__.py")))), in_root(r, F.concat(rest, F.lit(".py"))), in_root(r, F.concat(rest, F.lit("/__init__.py"))))))
    java = F.transform(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda n: F.array_join(F.slice(F.split("file", "/"), 1, n - 1), "/"))), lambda r: in_root(r, F.concat(F.replace(src, F.lit("."), F.lit("/")), F.when(F.col("name") != "*", F.concat(F.lit("/"), "name")).otherwise(""), F.lit(".java"))))
    tries = F.when(F.endswith("file", F.lit(".py")), dotted).when(F.endswith("file", F.lit(".java")), java).when(relative, script).otherwise(F.array().cast("array<string>"))
    numbered = imports.withColumn("__id", F.xxhash64(*[F.col(c).cast("string") for c in imports.columns]))
    return first_match(numbered, "__id", F.filter(tries, lambda x: x.isNotNull() & (x != "")), files, "file", "resolved_file").drop("__id")


def type_facts(g: dict[str, DataFrame]) -> DataFrame:
    """file, function (null at module level), class, variable, type: declared or constructed variables and parameters."""
    t = g["types"].where("type is not null").select("file", F.col("owner_function").alias("function"), F.col("owner_class").alias("class"), "variable", "type")
    p = g["parameters"].where("type is not null and type <> ''").select("file", "function", "class", F.col("name").alias("variable"), "type")
    return t.unionByName(p).groupBy("file", "function", "class", "variable").agg(F.min("type").alias("type"), F.count_distinct("type").alias("n")).where("n = 1").drop("n")


def resolve_calls(calls: DataFrame, g: dict[str, DataFrame], facts: DataFrame, imports: DataFrame) -> DataFrame:
    """calls with resolved_file, resolved_name, resolved_class, resolution, external.

    An ordered cascade, each step a left join and the first that hits wins: typed receiver (and this/self, super), class receiver, imported object, imported name (through re-exports), star import, nearest
    local definition; then builtin, external package, and a project-wide name that one class only defines.
    """
    functions, classes = g["functions"], g["classes"]
    current = R.last_wins(functions)
    method = functions.where("class is not null").select("class", F.col("name").alias("method"), F.col("file").alias("m_file")).groupBy("class", "method").agg(F.min("m_file").alias("file"))
    parents = classes.where("superclass is not null").select("class", "superclass").distinct()
    head = F.regexp_extract("object", r"^([\w$]+)", 1)
    own = calls.withColumns({"head": F.when(F.col("object").isNotNull(), head), "tail": F.regexp_extract("object", r"^(?:self|this)\.([\w$]+)$", 1)})
    receiver = facts.select(F.col("file").alias("r_file"), F.col("function").alias("r_function"), F.col("class").alias("r_class"), F.col("variable").alias("r_object"), F.col("type").alias("t1"))
    same = (F.col("file") == F.col("r_file")) & F.col("owner_function").eqNullSafe(F.col("r_function")) & F.col("owner_class").eqNullSafe(F.col("r_class")) & (F.col("object") == F.col("r_object"))
    typed = own.join(receiver, same, "left").drop("r_file", "r_function", "r_class", "r_object")
    module = facts.where("function is null").groupBy("file", "variable").agg(F.min("type").alias("t2")).withColumnRenamed("variable", "object")
    typed = typed.join(module, ["file", "object"], "left")
    fields = facts.where(F.col("variable").rlike(r"^(self|this)\.")).groupBy("file", F.col("class").alias("owner_class"), F.col("variable").alias("object")).agg(F.min("type").alias("t3"))
    typed = typed.join(fields, ["file", "owner_class", "object"], "left")
    typed = typed.join(parents.groupBy(F.col("class").alias("owner_class")).agg(F.min("superclass").alias("super")), "owner_class", "left")
    known = classes.select(F.col("class").alias("object")).distinct().withColumn("is_class", F.lit(True))
    typed = typed.join(known, "object", "left")
    on = F.coalesce("t1", "t3", "t2", F.when(F.col("object").isin("self", "this", "cls"), F.col("owner_class")), F.when(F.col("object").isin("super()", "super"), F.col("super")), F.when(F.col("is_class"), F.col("object")), F.when(F.col("object").isNull() & F.endswith("file", F.lit(".java")), F.col("owner_class")))
    typed = cut(typed.withColumn("on_class", on))
    chained = R.up_the_classes(typed.where("on_class is not null").select(F.col("on_class").alias("class"), F.col("function").alias("method")).distinct(), parents, method)
    by_type = chained.where("owner is not null").select(F.col("class").alias("on_class"), F.col("method").alias("function"), F.col("owner").alias("c1"), F.col("file").alias("f1"))
    out = typed.join(by_type, ["on_class", "function"], "left")
    # imported objects and names
    linked = imports.where("resolved_file is not null").select("file", "local", "name", "resolved_file")
    modules = linked.groupBy("file", F.col("local").alias("head")).agg(F.min("resolved_file").alias("m2"), F.min("name").alias("n2"))
    out = out.join(modules, ["file", "head"], "left")
    names = linked.groupBy("file", F.col("local").alias("function")).agg(F.min("resolved_file").alias("m3"), F.min("name").alias("n3"))
    out = out.join(names, ["file", "function"], "left")
    defined = current.select(F.col("file").alias("at_file"), F.col("name").alias("at_name"), "class").unionByName(classes.select(F.col("file").alias("at_file"), F.col("class").alias("at_name"), F.lit(None).cast("string").alias("class")))
    exports = g["reexports"].where("resolved_file is not null").select("file", "exported", F.col("resolved_file").alias("source_file"), "original", "is_star", "pos")
    wanted = out.where("m3 is not null").select(F.col("m3").alias("file"), F.coalesce(F.when(~F.col("n3").isin("default", "*module*"), F.col("n3")), "function").alias("name")).distinct()
    chased = R.through_reexports(wanted, exports, defined.select(F.col("at_file").alias("file"), F.col("at_name").alias("name")))
    out = out.withColumn("want", F.coalesce(F.when(~F.col("n3").isin("default", "*module*"), F.col("n3")), "function"))
    out = out.join(chased.select(F.col("file").alias("m3"), F.col("name").alias("want"), F.col("target_file").alias("f3"), F.col("target_name").alias("name3")), ["m3", "want"], "left")
    by_object = defined.groupBy(F.col("at_file").alias("m2"), F.col("at_name").alias("function")).agg(F.lit(True).alias("hit2"))
    out = out.join(by_object, ["m2", "function"], "left")
    stars = imports.where("is_star and resolved_file is not null").select("file", F.col("resolved_file").alias("s_file")).join(defined.select(F.col("at_file").alias("s_file"), F.col("at_name").alias("function")), "s_file").groupBy("file", "function").agg(F.min("s_file").alias("f4"))
    out = out.join(stars, ["file", "function"], "left")
    local = R.last_wins(functions).select("file", F.col("name").alias("function"), F.col("class").alias("c5"), F.lit(True).alias("hit5")).where("c5 is null")
    out = out.join(local, ["file", "function"], "left")
    made = classes.groupBy("file", F.col("class").alias("function")).agg(F.lit(True).alias("hit6"))
    out = out.join(made, ["file", "function"], "left")
    owners = R.unique_owner(functions.where("class is not null").select("name", "class", "file", F.lit(False).alias("is_bundle"))).select(F.col("name").alias("function"), F.col("class").alias("c7"), F.col("file").alias("f7"))
    out = out.join(owners, "function", "left")
    external = imports.where("resolved_file is null").groupBy("file", F.col("local").alias("head")).agg(F.lit(True).alias("ext1"))
    ext_name = imports.where("resolved_file is null").groupBy("file", F.col("local").alias("function")).agg(F.lit(True).alias("ext2"))
    out = out.join(external, ["file", "head"], "left").join(ext_name, ["file", "function"], "left")
    bare = F.col("object").isNull()
    steps = [
        (F.col("f1").isNotNull(), "f1", "function", "c1", "typed-receiver"),
        (F.col("hit2"), "m2", "function", None, "imported-object"),
        (bare & F.col("f3").isNotNull(), "f3", "name3", None, "import"),
        (bare & F.col("f4").isNotNull(), "f4", "function", None, "star-import"),
        (bare & (F.col("hit5") | F.col("hit6")), "file", "function", None, "local"),
    ]
    no = F.lit(None).cast("string")
    builtin = (bare & F.col("function").isin(*BUILTINS)) | (~bare & F.col("function").isin(*BUILTIN_METHODS))
    outside = F.coalesce("ext1", F.lit(False)) | (bare & F.coalesce("ext2", F.lit(False)))
    guess = ~bare & F.col("f7").isNotNull() & ~builtin & ~outside & ~F.col("implicit")

    def pick(which: int, last: Column) -> Column:
        col_of = lambda s: no if s[which] is None else (F.col(s[which]) if which < 4 else F.lit(s[which]))
        chain = F.when(steps[0][0], col_of(steps[0]))
        for s in steps[1:]:
            chain = chain.when(s[0], col_of(s))
        return chain.when(guess, last)

    done = out.select(
        *[c for c in calls.columns], pick(1, F.col("f7")).alias("resolved_file"), pick(2, F.col("function")).alias("resolved_name"), pick(3, F.col("c7")).alias("resolved_class"),
        F.coalesce(pick(4, F.lit("name-unique")), F.when(builtin, "builtin"), F.when(outside, "external"), F.when(F.col("dispatch").isNotNull(), "dispatch")).alias("resolution"),
    )
    return done.withColumn("external", F.coalesce(F.col("resolution").isin("builtin", "external"), F.lit(False)))


def infer(g: dict[str, DataFrame], imports: DataFrame, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Calls resolved and types inferred together, until neither grows or `rounds` is reached.

    A round resolves the calls with the types known so far; from them come types of variables assigned from a call whose function declares or returns one type, and of parameters whose arguments have one type at all call
    sites. A type is only added where there was none, so the loop ends.
    """
    facts = cut(type_facts(g))
    returns = g["functions"].where("return_type is not null and return_type <> ''").select(F.col("file").alias("resolved_file"), F.col("name").alias("resolved_name"), F.col("class").alias("resolved_class"), F.regexp_replace("return_type", r"^.*\.|[\[<].*$", "").alias("type"))
    made = g["returns"].select(F.col("file").alias("resolved_file"), F.col("function").alias("resolved_name"), F.col("class").alias("resolved_class"), F.regexp_extract("value", r"^(?:new\s+)?(?:[\w$]+\.)*([A-Z][\w$]*)\(", 1).alias("type")).where("type <> ''")
    result = returns.unionByName(made).groupBy("resolved_file", "resolved_name", "resolved_class").agg(F.count_distinct("type").alias("n"), F.min("type").alias("type")).where("n = 1").drop("n")
    calls, before = None, (-1, -1)
    for _ in range(rounds):
        calls = cut(resolve_calls(g["calls"], g, facts, imports))
        resolved = calls.where("resolved_file is not null")
        now = (resolved.count(), facts.count())
        if now == before:
            break
        before = now
        keys = ["resolved_file", "resolved_name"]
        typed = resolved.select("call_id", *keys, F.col("resolved_class").alias("of_class")).join(result, keys).where(F.col("resolved_class").eqNullSafe(F.col("of_class"))).select(F.col("call_id").alias("from_call"), F.col("type").alias("made"))
        open_types = g["types"].where("type is null and from_call is not null").drop("type")
        from_calls = open_types.join(typed, "from_call").select("file", F.col("owner_function").alias("function"), F.col("owner_class").alias("class"), "variable", F.col("made").alias("type"))
        known = facts.select("file", F.col("function").alias("k_function"), F.col("class").alias("k_class"), F.col("variable").alias("value"), "type")
        here = F.col("owner_function").eqNullSafe(F.col("k_function")) & F.col("owner_class").eqNullSafe(F.col("k_class"))
        args = g["arguments"].where("pos >= 0").join(known, ["file", "value"]).where(here).select("call_id", "pos", "type")
        to = resolved.select("call_id", "resolved_file", "resolved_name", "resolved_class")
        sites = args.join(to, "call_id")
        params = g["parameters"].where("group_type = 'positional'").select(F.col("file").alias("resolved_file"), F.col("function").alias("resolved_name"), F.col("class").alias("class"), "pos", "name")
        from_flow = sites.join(params, ["resolved_file", "resolved_name", "pos"]).where(F.col("class").eqNullSafe(F.col("resolved_class"))).select(F.col("resolved_file").alias("file"), F.col("resolved_name").alias("function"), "class", F.col("name").alias("variable"), "type")
        fresh = from_calls.unionByName(from_flow).groupBy("file", "function", "class", "variable").agg(F.count_distinct("type").alias("n"), F.min("type").alias("type")).where("n = 1").drop("n")
        on = [fresh[c].eqNullSafe(facts[c]) for c in ("file", "function", "class", "variable")]
        facts = cut(facts.unionByName(fresh.join(facts, on, "left_anti")))
    return calls, facts


def execution_edges(g: dict[str, DataFrame], calls: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Edges of the execution graph: resolved calls, constructors, routes and their middlewares, database access, implementations of overridden methods, nested functions, dispatch tables, and those of the linkers."""
    fn = lambda f, n, c, line=None: node("FUNCTION", file=F.col(f), function=F.col(n), class_=F.col(c) if c else None, line=F.col(line) if line else None)
    none = F.lit(None).cast("string")
    cols = lambda kind, src, dst, conf, via, call=none, test=F.lit(False): [F.lit(kind).alias("edge_type"), src.alias("src"), dst.alias("dst"), call.alias("call_id"), test.alias("is_test"), conf.alias("confidence"), F.lit(via).alias("via")]
    hit = calls.where("resolved_file is not null and owner_function is not null")
    label = F.when(F.col("resolution") == "name-unique", "name-unique").otherwise("resolved")
    direct = hit.select(*cols("FUNCTION_CALL", fn("file", "owner_function", "owner_class"), fn("resolved_file", "resolved_name", "resolved_class"), label, None, F.col("call_id"), F.col("is_test")))
    inits = g["functions"].where("name in ('__init__', 'constructor')").select(F.col("file").alias("resolved_file"), F.col("class").alias("resolved_name"), F.col("name").alias("init"))
    built = hit.join(inits, ["resolved_file", "resolved_name"]).select(*cols("FUNCTION_CALL", fn("file", "owner_function", "owner_class"), fn("resolved_file", "init", "resolved_name"), F.lit("resolved"), "constructor", F.col("call_id"), F.col("is_test")))
    handler = F.element_at(F.split("handler", r"\."), -1)
    where = R.last_wins(g["functions"]).select(F.col("name").alias("h"), F.col("file").alias("h_file"), F.col("class").alias("h_class"), "start_line")
    local = Window.partitionBy("file", "method", "path", "h").orderBy((F.col("file") != F.col("h_file")).cast("int"), "h_file")
    route = lambda: node("ROUTE", file=F.col("file"), route=F.col("path"), method=F.col("method"))
    to = g["routes"].withColumn("h", handler).join(where, "h").withColumn("__n", F.row_number().over(local)).where("__n = 1")
    routed = to.select(*cols("ROUTE_CALL", route(), fn("h_file", "h", "h_class"), F.lit("resolved"), None))
    guarded = g["routes"].select("*", F.explode("middlewares").alias("m")).select(*cols("ROUTE_MIDDLEWARE", route(), node("MIDDLEWARE", file=F.col("file"), function=F.element_at(F.split("m", r"\."), -1)), F.lit("resolved"), None))
    stored = g["database_ops"].where("function is not null").select(*cols("DB_ACCESS", fn("file", "function", "class"), node("DATABASE", model=F.col("model")), F.lit("resolved"), None))
    m = g["functions"].where("class is not null").select("file", "name", "class")
    faces = g["classes"].select("class", F.explode(F.array_union(F.array("superclass"), "interfaces")).alias("up")).where("up is not null")
    low, high = m.select("name", F.col("class").alias("class"), F.col("file").alias("l_file")), m.select("name", F.col("class").alias("up"), F.col("file").alias("u_file"))
    overridden = faces.join(low, "class").join(high, ["up", "name"]).where("name not in ('__init__', 'constructor')").select(*cols("FUNCTION_CALL", fn("u_file", "name", "up"), fn("l_file", "name", "class"), F.lit("candidates"), "override"))
    nested = g["functions"].where("parent is not null").select(*cols("FUNCTION_CALL", fn("file", "parent", None), fn("file", "name", "class"), F.lit("nested"), "nested", none, F.col("is_test")))
    tables = g["constants"].where("kind = 'dispatch_table'").select("file", F.col("name").alias("function"), F.explode("targets").alias("target"))
    picked = calls.where("dispatch = 'table' and owner_function is not null").join(tables, ["file", "function"]).select(*cols("FUNCTION_CALL", fn("file", "owner_function", "owner_class"), fn("file", "target", None), F.lit("dispatch"), "dispatch", F.col("call_id"), F.col("is_test")))
    every = direct
    for more in (built, routed, guarded, stored, overridden, picked, *([linked] if linked is not None else [])):
        every = every.unionByName(more)
    have = every.where("edge_type = 'FUNCTION_CALL'").select("src.file", F.col("src.function").alias("p"), F.col("dst.function").alias("c")).distinct()
    fresh = nested.join(have, (nested["src"]["file"] == have["file"]) & (nested["src"]["function"] == have["p"]) & (nested["dst"]["function"] == have["c"]), "left_anti")
    out = every.unionByName(fresh).dropDuplicates(["edge_type", "src", "dst", "call_id"])
    return out.select(F.xxhash64("edge_type", "src", "dst", F.coalesce("call_id", F.lit(""))).alias("edge_id"), "*", F.lit(None).cast("boolean").alias("observed"), F.lit(None).cast("string").alias("source"))


def import_edges(imports: DataFrame) -> DataFrame:
    """Edges of type IMPORT between files, with the columns of execution_edges: what the policy DEPENDENCY_ONLY walks. imports: file, resolved_file, is_test."""
    none = F.lit(None).cast("string")
    links = imports.where("resolved_file is not null").groupBy("file", "resolved_file").agg(F.min(F.coalesce("is_test", F.lit(False))).alias("is_test"))
    ends = links.select(F.lit("IMPORT").alias("edge_type"), node("FILE", file=F.col("file")).alias("src"), node("FILE", file=F.col("resolved_file")).alias("dst"), none.alias("call_id"), "is_test", F.lit("resolved").alias("confidence"), none.alias("via"))
    return ends.select(F.xxhash64("edge_type", "src", "dst").alias("edge_id"), "*", F.lit(None).cast("boolean").alias("observed"), none.alias("source"))


def security(g: dict[str, DataFrame], calls: DataFrame) -> dict[str, DataFrame]:
    """data_flow, taint_sources, security_sinks, sanitizers and security_findings (tainted functions that reach a query without a sanitizer in them)."""
    params = g["parameters"].select(F.col("file").alias("target_file"), F.col("function").alias("target_function"), "pos", "group_type", F.col("name").alias("target_param"))
    to = calls.where("resolved_file is not null").select("call_id", F.col("resolved_file").alias("target_file"), F.col("resolved_name").alias("target_function"))
    sent = g["arguments"].where("pos >= 0").join(to, "call_id")
    plain = sent.join(params.where("group_type = 'positional'"), ["target_file", "target_function", "pos"]).select(F.col("file").alias("source_file"), F.col("owner_function").alias("source_function"), F.col("value").alias("source"), "target_file", "target_function", "target_param")
    rest = params.where("group_type = 'rest'").select("target_file", "target_function", F.col("pos").alias("from_pos"), "target_param")
    spread = sent.join(rest, ["target_file", "target_function"]).where("pos >= from_pos").select(F.col("file").alias("source_file"), F.col("owner_function").alias("source_function"), F.col("value").alias("source"), "target_file", "target_function", "target_param")
    flow = plain.unionByName(spread)
    tainted_vars = g["variable_states"].where("tainted").select(F.col("file").alias("source_file"), F.col("function").alias("source_function"), F.col("variable").alias("source")).distinct()
    by_input = flow.where(F.col("source").rlike(UNTRUSTED)).unionByName(flow.join(tainted_vars, ["source_file", "source_function", "source"], "left_semi").select(*flow.columns))
    inside = g["variable_states"].where("tainted").select("file", F.col("value").alias("source"), F.col("function").alias("target_function"), F.col("variable").alias("target_param"))
    sources = by_input.select(F.lit("USER_INPUT").alias("type"), F.col("target_file").alias("file"), "source", "target_function", "target_param").unionByName(inside.select(F.lit("USER_INPUT").alias("type"), "file", "source", "target_function", "target_param")).distinct()
    given = sources.join(g["returns"].select("file", F.col("function").alias("target_function"), F.col("value").alias("target_param")), ["file", "target_function", "target_param"], "left_semi")
    sources = sources.unionByName(given.withColumn("type", F.lit("RETURN_TAINT")).select(*sources.columns))
    sinks = g["database_ops"].where("function is not null").select(F.when(F.col("query").isNotNull(), "SQL_QUERY").otherwise("MONGODB_QUERY").alias("type"), "file", F.col("function").alias("target_function"), "operation", "model", "query")
    sanitizers = calls.where(F.col("function").rlike(SANITIZERS)).select("file", "function", F.col("owner_function").alias("caller_function")).distinct()
    risky = sources.select("file", "target_function", "source").distinct().join(sinks.drop("type"), ["file", "target_function"])
    clean = sanitizers.select("file", F.col("caller_function").alias("target_function")).distinct()
    findings = risky.join(clean, ["file", "target_function"], "left_anti").select(F.lit("TAINTED_DB_ACCESS").alias("type"), F.lit("HIGH").alias("severity"), "file", "source", F.col("operation").alias("sink"), "model", "target_function")
    return {"data_flow": flow, "taint_sources": sources, "security_sinks": sinks, "sanitizers": sanitizers, "security_findings": findings}


def gated(g: dict[str, DataFrame], frameworks: list[str], web: bool, database: bool) -> dict[str, DataFrame]:
    """The sections that depend on what the project imports: an express app's calls on its own router aren't calls of the project, and a method's name alone (`find`, `update`) makes a database operation
    only where a web or database package is imported; a query's text always does."""
    noise = F.col("object").isin(*K.NOISE_OBJECTS) & F.col("function").isin(*K.NOISE_FUNCTIONS)
    calls = g["calls"].where(~F.coalesce(noise, F.lit(False))) if "express" in frameworks else g["calls"]
    return {"calls": calls, "database_ops": g["database_ops"] if web or database else g["database_ops"].where("query is not null")}


def through_destructuring(calls: DataFrame, destructured: DataFrame) -> DataFrame:
    """calls in which a bare name that was taken out of an object (`const { find } = users`) is that object's function again."""
    named = destructured.where(F.col("source").rlike(r"^[A-Za-z_$][\w$.]*$"))
    found = R.resolve_destructured(calls.select("file", F.col("function").alias("name")).distinct(), named).where("source_object is not null")
    held = calls.join(found.withColumnRenamed("name", "function"), ["file", "function"], "left")
    taken = F.col("object").isNull() & F.col("source_object").isNotNull()
    return held.select(*[F.when(taken, F.col("source_object")).otherwise(F.col("object")).alias(c) if c == "object" else F.when(taken, F.col("original")).otherwise(F.col("function")).alias(c) if c == "function" else F.col(c) for c in calls.columns])


def build(files: DataFrame, matches: DataFrame) -> Graph:
    """The whole graph of a source tree. files: file, content, is_test; matches: extract.schema.MATCHES."""
    matches = cut(matches)
    g = declarations(matches)
    known = files.select("file").distinct()
    g["imports"] = cut(resolve_modules(g["imports"], known))
    gates = K.gates(g["imports"].select(F.lit(0).alias("project"), "source"), ["project"]).first()  # one row of a few fixed names
    g |= gated(g, *(gates["frameworks"], gates.web, gates.database) if gates else ([], False, False))
    g["calls"] = through_destructuring(g["calls"], g["destructured"])
    g["reexports"] = cut(resolve_modules(g["reexports"].withColumn("name", F.coalesce("original", F.lit("*"))), known).drop("name"))
    calls, facts = infer(g, g["imports"])
    g |= {"calls": calls, "types": facts}
    body = L.bodies(g["functions"], files)
    attributes = g["constants"].where("kind = 'class_attribute'").select("class", "name", "file")
    extra = L.attribute_uses(body, attributes, g["classes"]).unionByName(L.constant_uses(body, g["constants"].where("kind in ('module', 'dispatch_table')").select("file", "name").distinct(), g["imports"]))
    extra = extra.unionByName(L.fixture_edges(g["functions"], g["parameters"])).unionByName(L.alias_calls(calls, g["aliases"], g["functions"]))
    g["execution_edges"] = cut(execution_edges(g, calls, extra))
    g |= security(g, calls)
    from .symbols import symbol_index

    g["symbol_index"] = symbol_index(g["functions"].select("file", "name", "class"), g["classes"].select("file", "class"))
    return Graph(g)


def resolution_metrics(calls: DataFrame) -> DataFrame:
    """By kind of receiver: calls, how many are resolved, labelled external, or open, and the percentage that isn't open."""
    kind = F.when(F.col("object").isNull(), "bare").when(F.col("object").rlike("^(self|this)$"), "this").otherwise("object")
    sums = calls.groupBy(kind.alias("receiver")).agg(F.count("*").alias("calls"), F.count(F.when(F.col("resolved_file").isNotNull() | (F.col("resolution") == "dispatch"), 1)).alias("resolved"), F.count(F.when(F.col("external"), 1)).alias("external"))
    return sums.withColumns({"open": F.col("calls") - F.col("resolved") - F.col("external"), "percent": F.round(100 * (F.col("resolved") + F.col("external")) / F.col("calls"), 1)})
