"""Source trees and what is in them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..extract.schema import MATCHES
from ..functions import paths
from ..plans.nodes import normal_path

# Packages that tell a framework, and the manifests that name packages.
FRAMEWORKS = {"express": "express", "fastify": "fastify", "@nestjs/core": "nest", "koa": "koa", "mongoose": "mongoose", "sequelize": "sequelize", "flask": "flask", "django": "django", "fastapi": "fastapi", "sqlalchemy": "sqlalchemy", "pytest": "pytest", "spring-boot": "spring"}
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml", "setup.py", "Pipfile", "pom.xml", "build.gradle")


def repo_files(spark: SparkSession, directory: str, tests: bool = True) -> DataFrame:
    """The source files under a folder: file (relative, with slashes), content, sha256, mtime, size, ext, is_test, is_bundle. Pruned folders, minified and unknown files are left out.

    Spark's file sources skip names that begin with an underscore, such as `__init__.py`; these few are found and read through the same file system by the driver.
    """
    root = directory.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content", "modificationTime", "length")
    hidden = spark.createDataFrame(_underscored(spark, root), "path string, content binary, modificationTime timestamp, length bigint")
    rel = F.regexp_replace(F.col("path"), "^.*?" + _literal(root) + "/", "")
    named = raw.unionByName(hidden).withColumn("file", normal_path(rel)).where(paths.is_source(F.col("file"), tests))
    return named.select("file", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), paths.extension(F.col("file")).alias("ext"), paths.is_test(F.col("file")).alias("is_test"), paths.is_bundle(F.col("file")).alias("is_bundle"))


def _underscored(spark: SparkSession, root: str) -> list[tuple]:
    from datetime import datetime, timezone

    jvm = spark._jvm
    start = jvm.org.apache.hadoop.fs.Path(root)
    fs = start.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = fs.listFiles(start, True), []
    while found.hasNext():
        status = found.next()
        path = status.getPath()
        if path.getName().startswith("_") and path.getName().endswith(tuple(paths.EXTENSIONS)) and not set(path.toString().split("/")) & set(paths.IGNORED_DIRS):
            stream = fs.open(path)
            content = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            stream.close()
            out.append((path.toString(), content, datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc), status.getLen()))
    return out


def _literal(text: str) -> str:
    import re

    return re.escape(text)


def read_matches(files: DataFrame) -> DataFrame:
    """Matches of every file (extract.schema.MATCHES), file by file on the workers; a file that can't be parsed has none. files: file, content, is_test."""
    schema = to_arrow_schema(StructType.fromJson(_parse_datatype_string(MATCHES).jsonValue()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..extract import brace_source, python_source

        for batch in batches:
            for file, content, test in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                read = python_source.extract if file.endswith(".py") else brace_source.extract
                rows = list(read(file, content or "", bool(test)))
                for row in rows:
                    row["captures"] = list(row["captures"].items())
                if rows:
                    yield from pa.Table.from_pylist(rows, schema).to_batches()

    return files.select("file", "content", "is_test").mapInArrow(run, MATCHES)


def frameworks(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Frameworks that imports, or the text of manifests (file, content), name."""
    known = F.create_map(*[F.lit(x) for pair in FRAMEWORKS.items() for x in pair])
    words = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"""['"\s>]((?:@[\w-]+/)?[A-Za-z][\w-]*)"""), 1)))
    text = files.select("content") if manifests is None else files.select("content").unionByName(manifests.select("content"))
    return text.select(words.alias("word")).select(F.try_element_at(known, F.lower("word")).alias("framework")).where("framework is not null").distinct()


def option_defaults(matches: DataFrame) -> DataFrame:
    """Types of options that all their defaults agree on. From constants whose value constructs something."""
    made = matches.where("match_type = 'CONSTANT'").select(F.col("captures.name")[0].alias("key"), F.regexp_extract(F.col("captures.value")[0], r"^([A-Z]\w*)\(", 1).alias("type")).where("type <> ''")
    return made.groupBy("key").agg(F.count_distinct("type").alias("n"), F.min("type").alias("type")).where("n = 1").drop("n")


def changed_lines(diff: DataFrame) -> DataFrame:
    """file, line of the lines that a unified diff adds or changes. diff: one column `diff`, or many rows of whole diffs.

    Each hunk is one row: its lines that aren't removals are numbered from the hunk's start, and the added ones are taken.
    """
    parts = diff.select(F.explode(F.split("diff", r"(?m)^diff --git ")).alias("part")).where("part <> ''")
    named = parts.select(F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?(\S+)", 1).alias("file"), F.posexplode(F.split("part", r"(?m)^@@ ")).alias("nth", "hunk")).where("nth > 0 and file <> '/dev/null' and file <> ''")
    head = F.regexp_extract("hunk", r"^-\d+(?:,\d+)? \+(\d+)", 1).cast("int")
    body = F.filter(F.slice(F.split("hunk", "\n"), 2, 1_000_000), lambda x: ~F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("\\")))
    rows = named.select("file", head.alias("start"), F.posexplode(body).alias("at", "text")).where(F.startswith("text", F.lit("+")))
    return rows.select("file", (F.col("start") + F.col("at")).alias("line"))
