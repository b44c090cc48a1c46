"""Symbol index, ranked search, skeletons and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import idf, query_words, subwords

#: Most points of each kind of evidence for one file.
CAPS = {"symbol": 30.0, "sub": 8.0, "lit": 24.0, "litpart": 6.0, "name": 3.0}


class TargetError(ValueError):
    """A target that names nothing, or more than one thing; candidates has what it could mean."""

    def __init__(self, message: str, candidates: list[str] = ()):
        super().__init__(message)
        self.candidates = list(candidates)


def symbol_index(functions: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """symbol, file for bare names, dotted names' last parts, Class.name and class names. functions: file, name, class; classes: file, class."""
    dotted = functions.where(F.contains("name", F.lit("."))).select(F.element_at(F.split("name", r"\."), -1).alias("symbol"), "file")
    parts = [functions.select(F.col("name").alias("symbol"), "file"), dotted, functions.where("class is not null and class <> ''").select(F.concat_ws(".", "class", "name").alias("symbol"), "file")]
    parts.append(functions.where("class is not null and class <> ''").select(F.col("class").alias("symbol"), "file"))
    if classes is not None:
        parts.append(classes.select(F.col("class").alias("symbol"), "file"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.where("symbol is not null and symbol <> ''").distinct()


def resolve_target(functions: DataFrame, spec: str) -> dict:
    """What a spec names: FUNCTION:name, FUNCTION:file:name, with Class.method for name, ROUTE:method:path[:file], FILE:path. Ambiguous function names are an error with the candidates."""
    kind, _, rest = spec.partition(":")
    if kind == "FILE":
        return {"type": "FILE", "file": rest}
    if kind == "ROUTE":
        method, _, path = rest.partition(":")
        path, _, file = path.partition(":")
        return {"type": "ROUTE", "method": method.upper(), "route": path, "file": file or None}
    if kind != "FUNCTION" or not rest:
        raise TargetError(f"unknown target: {spec}")
    file, _, name = rest.rpartition(":")
    cls, _, method = name.rpartition(".")
    hit = functions.where(F.col("name") == (method if cls else name))
    if cls:
        hit = hit.where(F.col("class") == cls).unionByName(functions.where(F.col("name") == name))
    if file:
        hit = hit.where((F.col("file") == file) | F.col("file").endswith("/" + file))
    rows = hit.select("file", "name", "class").distinct().orderBy("file", "class", "name").limit(13).collect()
    if len(rows) != 1:
        raise TargetError(f"{spec} is " + ("unknown" if not rows else "ambiguous"), [f"{r.file}:{r['class'] + '.' if r['class'] else ''}{r.name}" for r in rows[:12]] + ["…"] * (len(rows) > 12))
    return {"type": "FUNCTION", "file": rows[0].file, "function": rows[0].name, "class": rows[0]["class"]}


def idf_table(symbols: DataFrame, word: str = "word", owner: str = "symbol") -> DataFrame:
    """word, df, idf of (owner, word) pairs; df counts owners."""
    total = symbols.agg(F.count_distinct(owner).alias("total"))
    counted = symbols.groupBy(word).agg(F.count_distinct(owner).alias("df"))
    return counted.crossJoin(F.broadcast(total)).select(F.col(word).alias("word"), "df", idf(F.col("df"), F.col("total")).alias("idf"))


def find_symbols(symbols: DataFrame, query: str, literals: DataFrame | None = None, limit: int = 10, reasons: int = 6) -> DataFrame:
    """Files ranked by how well their symbols, literals and names fit a free text.

    symbols: file, name, class (null allowed). literals: file, text. Evidence: a name that is a query word (10 x max(.25, idf)), a class that is (6 x, once a file and
    class), two or more shared sub-words, or the only one if rare (2 x idf each), a literal within the query (8 + min(len, 40) / 8) or around it (6), half of a literal's words (1.5
    each), a word of the file's name (3). Points are summed by file and kind, cut to CAPS, and added up; ties go by file. The query's words are few and go with the plan as literals.
    """
    spark = symbols.sparkSession
    asked = [r.w for r in spark.range(1).select(F.explode(query_words(F.lit(query))).alias("w")).collect()] if query else []
    parts = sorted({p for w in asked for p in _subwords(w)} | {w for w in asked if len(w) >= 3})
    asked_col, parts_col = F.array(*map(F.lit, asked)).cast("array<string>"), F.array(*map(F.lit, parts)).cast("array<string>")
    named = symbols.select("file", "name", "class").distinct().withColumn("subs", F.array_distinct(subwords(F.col("name"))))
    total = named.agg(F.count("*").alias("total"))
    df = named.select(F.explode(F.array_union(F.array(F.lower("name")), F.col("subs"))).alias("word"), "file", "name", "class").groupBy("word").agg(F.count("*").alias("df"))
    few = F.broadcast(df.where(F.col("word").isin(*asked, *parts) if asked or parts else F.lit(False)).crossJoin(total).select("word", idf(F.col("df"), F.col("total")).alias("idf")))
    exact = named.join(few, F.lower("name") == few["word"]).where(F.array_contains(asked_col, F.col("word"))).select("file", F.lit("symbol").alias("kind"), (10 * F.greatest(F.lit(0.25), F.col("idf"))).alias("points"), F.concat(F.lit("name "), "name").alias("reason"))
    class_idf = named.select(F.lower("class").alias("low"), "file", "class").where("class is not null").distinct().where(F.array_contains(asked_col, F.col("low"))).join(few, F.col("low") == few["word"], "left")
    by_class = class_idf.select("file", F.lit("symbol").alias("kind"), (6 * F.greatest(F.lit(0.25), F.coalesce("idf", F.lit(1.0)))).alias("points"), F.concat(F.lit("class "), "class").alias("reason"))
    shared = named.select("file", "name", "class", F.size("subs").alias("n"), F.explode(F.array_intersect("subs", parts_col)).alias("word")).join(few, "word")
    subs = shared.groupBy("file", "name", "class", "n").agg(F.count("*").alias("hits"), F.sum("idf").alias("sum"), F.max("idf").alias("top")).where("hits >= 2 or (n = 1 and top > 0.6)")
    by_sub = subs.select("file", F.lit("sub").alias("kind"), (2 * F.col("sum")).alias("points"), F.concat(F.lit("parts of "), "name").alias("reason"))
    base = F.lower(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1))
    long = F.filter(asked_col, lambda w: F.length(w) >= 4)
    by_name = symbols.select("file").distinct().where(F.exists(long, lambda w: F.contains(base, w))).select("file", F.lit("name").alias("kind"), F.lit(3.0).alias("points"), F.lit("file name").alias("reason"))
    every = exact.unionByName(by_class).unionByName(by_sub).unionByName(by_name)
    if literals is not None:
        low, whole = F.lower("text"), F.lit(query.lower())
        lit_words = F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), 0), lambda w: F.length(w) >= 3))
        overlap = F.size(F.array_intersect(lit_words, asked_col))
        points = F.when((F.length("text") >= 6) & F.contains(whole, low), 8 + F.least(F.length("text"), F.lit(40)) / 8).when((F.length(whole) >= 8) & F.contains(low, whole), 6.0)
        part = F.when((overlap >= 2) & (overlap * 2 >= F.size(lit_words)), 1.5 * overlap)
        seen = literals.select("file", F.when(points.isNotNull(), "lit").otherwise("litpart").alias("kind"), F.coalesce(points, part).alias("points"), F.concat(F.lit("text "), F.substring("text", 1, 40)).alias("reason"))
        every = every.unionByName(seen.where("points is not null"))
    cap = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    capped = every.groupBy("file", "kind").agg(F.least(F.sum("points"), cap[F.col("kind")]).alias("points"))
    score = capped.groupBy("file").agg(F.round(F.sum("points"), 1).alias("score"))
    top = Window.partitionBy("file").orderBy(F.desc("points"), "kind", "reason")
    why = every.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= reasons).groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "reason"))), lambda x: x["reason"]).alias("reasons"))
    return score.join(why, "file").orderBy(F.desc("score"), "file").limit(max(1, limit))


def _subwords(word: str) -> list[str]:
    import re

    return [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", word) if len(p) >= 3]


def skeleton(functions: DataFrame, files: DataFrame, max_symbols: int = 60) -> DataFrame:
    """The first symbols of files in source order, and whether there were more. functions: file, name, class, start_line."""
    own = functions.join(files.select("file").distinct(), "file", "left_semi")
    place = Window.partitionBy("file").orderBy("start_line", "name")
    ranked = own.withColumns({"nth": F.row_number().over(place), "n": F.count("*").over(Window.partitionBy("file"))})
    return ranked.where(F.col("nth") <= max_symbols).select("file", "nth", "name", "class", "start_line", (F.col("n") > max_symbols).alias("truncated"))


def literals(texts: DataFrame, limit: int = 200) -> DataFrame:
    """The first distinct literals of each file that read like text: 4 to 120 characters, not a path, with a space or no identifier. texts: file, pos, text."""
    text = F.col("text")
    wanted = F.length(text).between(4, 120) & ~text.rlike(r"^[./~]|^[A-Za-z]+://") & (F.contains(text, F.lit(" ")) | ~text.rlike(r"^[A-Za-z0-9_$]+$"))
    first = texts.where(wanted).groupBy("file", "text").agg(F.min("pos").alias("pos"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).where(F.col("nth") <= limit)


# Words that the ranking leaves out; its words and the parts of identifiers.
RANK_STOP = "all and any are but can does for from has have into not out should that the this use used using was when with you".split()
RANK_WORD, RANK_PART = r"[A-Za-z_$][A-Za-z0-9_$]*", r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"
# Folders whose literals don't count unless tests do.
RANK_TEST_DIRS = "test tests __tests__ spec".split()


def rank_files(symbols: DataFrame, query: str, literals: DataFrame | None = None, limit: int = 10, include_tests: bool = False) -> DataFrame:
    """Files ranked against a free text by the evidence of their symbols, literals and names, with the score rounded to a tenth.

    symbols: file, name, class (null allowed), one row each definition. literals: file, text. Of a symbol the first that holds counts: its name is a word of the query (10 x at least .25 of
    its rarity), its class is (6 x, once a file and class), or its name and class share two parts with the query, or consist of one rare part that it has (twice the rarities). A literal that is
    within the query (8 and an eighth of its length, up to 13), around it (6), or half of whose words are in the query (1.5 each); a word of four letters or more in the file's name (3). The points of
    each kind are added up to CAPS. The rarity of a part is max(.15, 1 - log(1 + df) / log(1 + n)) over all definitions. The query's words go with the plan as literals; ties go by file.
    """
    import re

    asked = [w for w in re.findall(RANK_WORD, query) if len(w) >= 2]
    words = sorted({w.lower() for w in asked} - set(RANK_STOP))
    parts = sorted({p.lower() for w in asked for p in re.findall(RANK_PART, w) if len(p) >= 3} - set(RANK_STOP))
    listed = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    split = lambda c: F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(RANK_PART), 0), F.lower), lambda x: F.length(x) >= 3)
    named = symbols.where("name is not null and name <> ''").select("file", "name", F.nullif("class", F.lit("")).alias("class")).withColumn("subs", F.array_distinct(F.concat(split(F.col("name")), split(F.col("class")))))
    total = named.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    df = named.select(F.explode("subs").alias("word")).where(F.col("word").isin(*words, *parts, "")).groupBy("word").agg(F.count("*").alias("df"))
    rows = total.join(df, F.lit(True), "left").groupBy("total").agg(F.map_from_entries(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "df")))).alias("dfs"))  # one row, at most a word of the query each
    held = named.crossJoin(F.broadcast(rows))
    rare = lambda w: F.greatest(F.lit(0.15), 1 - F.log1p(F.coalesce(F.try_element_at("dfs", w), F.lit(0))) / F.log1p("total"))
    in_words = lambda c: F.coalesce(F.array_contains(listed(words), F.lower(c)), F.lit(False))
    shared = F.array_intersect("subs", listed(parts))
    way = F.when(in_words("name"), "name").when(in_words("class"), "class").when((F.size(shared) >= 2) | ((F.size(shared) == 1) & (F.size("subs") == 1) & (rare(F.get(shared, F.lit(0))) > 0.6)), "sub")
    found = held.select("*", way.alias("way"), shared.alias("shared")).where("way is not null")
    by_name = found.where("way = 'name'").select("file", F.lit("symbol").alias("kind"), (10 * F.greatest(F.lit(0.25), rare(F.lower("name")))).alias("points"))
    by_class = found.where("way = 'class'").select("file", "class", F.lit("symbol").alias("kind"), (6 * F.greatest(F.lit(0.25), rare(F.lower("class")))).alias("points")).dropDuplicates(["file", "class"]).drop("class")
    by_part = found.where("way = 'sub'").select("file", F.lit("sub").alias("kind"), F.aggregate(F.transform("shared", lambda w: 2 * rare(w)), F.lit(0.0).cast("double"), lambda a, b: a + b).alias("points"))
    base = F.lower(F.element_at(F.split("file", "/"), -1))
    files = symbols.select("file") if literals is None else symbols.select("file").unionByName(literals.select("file"))
    by_file = files.distinct().where(F.exists(listed([w for w in words if len(w) >= 4]), lambda w: F.contains(base, w))).select("file", F.lit("name").alias("kind"), F.lit(3.0).alias("points"))
    every = by_name.unionByName(by_class).unionByName(by_part).unionByName(by_file)
    if literals is not None:
        if not include_tests:
            folders = F.split("file", "/")
            literals = literals.where(~F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), listed(RANK_TEST_DIRS)))
        low, whole = F.lower("text"), F.lit(query.strip().lower())
        own = F.array_except(F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit(RANK_WORD), 0), lambda w: F.length(w) >= 3)), listed(RANK_STOP))
        both = F.size(F.array_intersect(own, listed(words)))
        strong = F.when((F.length(low) >= 6) & F.contains(whole, low), 8 + F.least(F.length(low), F.lit(40)) / 8).when((F.length(whole) >= 8) & F.contains(low, whole), 6.0)
        weak = F.when((both >= 2) & (both >= F.size(own) * 0.5), 1.5 * both)
        seen = literals.select("file", F.when(strong.isNotNull(), "lit").otherwise("litpart").alias("kind"), F.coalesce(strong, weak).cast("double").alias("points")).where("points is not null")
        every = every.unionByName(seen)
    cap = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    capped = every.groupBy("file", "kind").agg(F.least(F.sum("points"), cap[F.col("kind")]).alias("points")).groupBy("file").agg(F.sum("points").alias("sum"))
    return capped.orderBy(F.desc(F.round("sum", 9)), "file").limit(max(1, limit)).select("file", F.round("sum", 1).alias("score"))
