"""Fixed knowledge about symbols and packages, and what it switches on or leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension, is_ignored

# Trusted symbols and their category.
TRUSTED = {"bcrypt.hash": "CRYPTO", "crypto.randomBytes": "CRYPTO", "validator.escape": "SANITIZER", "validator.normalizeEmail": "SANITIZER", "jwt.sign": "AUTH", "jwt.verify": "AUTH", "express.Router": "FRAMEWORK"}
# Packages that make a project a web or a database project; objects and functions of an express app that aren't calls of the project; extensions that are watched.
WEB = "express koa fastify hapi nest next flask django fastapi".split()
DATABASE = "mongoose sequelize prisma typeorm knex pg mysql mysql2 sqlite3 mongodb sqlalchemy redis ioredis".split()
NOISE_OBJECTS, NOISE_FUNCTIONS = "router app express".split(), "get post put delete patch use Router".split()
WATCHED = [".js", ".jsx", ".py"]


def trust_category(symbol: Column) -> Column:
    """The category of a trusted symbol, null for any other; few fixed symbols, so they go with the plan."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in TRUSTED.items() for x in pair]), symbol)


def package(source: Column) -> Column:
    """The package that an import names, without a scope's sign."""
    return F.lower(F.ltrim(F.split(F.coalesce(source, F.lit("")), "/")[0], F.lit("@")))


def gates(imports: DataFrame, by: list[str]) -> DataFrame:
    """For each project (columns `by`): its frameworks, and whether the heuristics for databases and for user input are on. imports: by, source."""
    known = F.when(package(F.col("source")).isin(*WEB, *DATABASE), package(F.col("source")))
    found = imports.groupBy(*by).agg(F.sort_array(F.collect_set(known)).alias("frameworks"))
    any_of = lambda names: F.arrays_overlap("frameworks", F.array(*map(F.lit, names)))
    return found.withColumns({"web": any_of(WEB), "database": any_of([*WEB, *DATABASE])})


def without_noise(calls: DataFrame, projects: DataFrame, by: list[str]) -> DataFrame:
    """calls (by, object, function) without what an express app calls on its own router. projects: by, frameworks, one row each."""
    noise = F.array_contains("frameworks", "express") & F.col("object").isin(*NOISE_OBJECTS) & F.col("function").isin(*NOISE_FUNCTIONS)
    return calls.join(projects.select(*by, "frameworks"), by, "left").where(~F.coalesce(noise, F.lit(False))).drop("frameworks")


def is_watched(path: Column) -> Column:
    return extension(path).isin(*WATCHED) & ~is_ignored(path)
