"""Queries over the driver's tables, by family, with the SQL that gives the same rows."""

from . import builder, code, graph, incremental, relational, resolve, scoring, streaming, symbols, telemetry

FAMILIES = (graph, symbols, resolve, telemetry, incremental, scoring, relational, streaming, code, builder)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLE = {name: sql for family in FAMILIES for name, sql in family.ORACLE.items()}
