"""Queries of the builder family: a small source tree goes through reading, resolution, linking and taint; the SQL holds the rows that the rules give for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import build as B
from ..operators import impact as I
from ..plans.nodes import node
from ..sources.files import read_matches

#: The source tree: a package with inheritance, re-exports and a star import; a web app with routes and a query; a test.
SOURCES = {
    "shop/__init__.py": "from .store import Store\nfrom .tools import *\n",
    "shop/base.py": "class Base:\n    level = 1\n\n    def log(self, text):\n        print(text)\n\n    def load(self, key):\n        raise NotImplementedError('no load')\n",
    "shop/store.py": (
        "from .base import Base\nfrom . import tools\n\n\nclass Store(Base):\n    def __init__(self, db):\n        self.db = db\n\n    def save(self, item):\n        checked = tools.check(item)\n"
        "        self.log(checked)\n        return self.load(checked)\n\n    def load(self, key):\n        return self.db.execute(\"SELECT * FROM items\")\n"
    ),
    "shop/tools.py": "def check(item):\n    return item\n\n\ndef twice(item):\n    return check(check(item))\n",
    "app.py": "from shop import Store, check\n\n\ndef main():\n    shop = Store(None)\n    shop.save(check(1))\n    return len([1])\n",
    "tests/test_store.py": "from shop.store import Store\n\n\ndef test_save():\n    store = Store(None)\n    store.save(1)\n",
    "web/routes.js": "const express = require('express');\nconst users = require('./users');\nconst router = express.Router();\n\nrouter.get('/users/:id', users.find);\nrouter.post('/users', users.create);\n\nmodule.exports = router;\n",
    "web/users.js": (
        "const db = require('./db');\n\nfunction find(req, res) {\n  const id = req.query.id;\n  return db.query('SELECT * FROM users WHERE id = ' + id);\n}\n\nfunction create(req, res) {\n  return store(req.body);\n}\n\n"
        "function store(body) {\n  return body;\n}\n\nmodule.exports = { find, create };\n"
    ),
    "web/db.js": "function query(sql) {\n  return sql;\n}\n\nmodule.exports = { query };\n",
}
#: The same tree after an edit: tools.check is renamed, store.save calls it by its new name.
EDITED = SOURCES | {"shop/tools.py": SOURCES["shop/tools.py"].replace("check", "verify"), "shop/store.py": SOURCES["shop/store.py"].replace("tools.check", "tools.verify")}

_BUILT: dict[tuple[str, str], B.Graph] = {}


def graph_of(spark: SparkSession, which: str = "first") -> B.Graph:
    """The graph of a tree, built once in a session; its sections are checkpointed."""
    held = (spark.sparkContext.applicationId, which)
    if held not in _BUILT:
        rows = SOURCES if which == "first" else EDITED
        files = spark.createDataFrame(sorted(rows.items()), "file string, content string").withColumn("is_test", paths.is_test(F.col("file")))
        _BUILT[held] = B.build(files, read_matches(files))
    return _BUILT[held]


def build_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark).functions.select("file", "class", "name", "start_line", "end_line", "is_test")


FUNCTIONS_SQL = """SELECT * FROM (VALUES ('app.py', NULL, 'main', 4, 7, false), ('shop/base.py', 'Base', 'log', 4, 5, false), ('shop/base.py', 'Base', 'load', 7, 8, false), ('shop/store.py', 'Store', '__init__', 6, 7, false),
('shop/store.py', 'Store', 'save', 9, 12, false), ('shop/store.py', 'Store', 'load', 14, 15, false), ('shop/tools.py', NULL, 'check', 1, 2, false), ('shop/tools.py', NULL, 'twice', 5, 6, false),
('tests/test_store.py', NULL, 'test_save', 4, 6, true), ('web/users.js', NULL, 'find', 3, 6, false), ('web/users.js', NULL, 'create', 8, 10, false), ('web/users.js', NULL, 'store', 12, 14, false),
('web/db.js', NULL, 'query', 1, 3, false)) t(file, class, name, start_line, end_line, is_test)"""


def build_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark).imports.select("file", "source", "local", "resolved_file")


IMPORTS_SQL = """SELECT * FROM (VALUES ('app.py', 'shop', 'Store', 'shop/__init__.py'), ('app.py', 'shop', 'check', 'shop/__init__.py'), ('shop/__init__.py', '.store', 'Store', 'shop/store.py'),
('shop/__init__.py', '.tools', '*', 'shop/tools.py'), ('shop/store.py', '.base', 'Base', 'shop/base.py'), ('shop/store.py', '.', 'tools', 'shop/tools.py'), ('tests/test_store.py', 'shop.store', 'Store', 'shop/store.py'),
('web/routes.js', 'express', 'express', NULL), ('web/routes.js', './users', 'users', 'web/users.js'), ('web/users.js', './db', 'db', 'web/db.js')) t(file, source, local, resolved_file)"""


def build_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with what it resolves to and how; calls on the app's own router are no calls of the project."""
    return graph_of(spark).calls.groupBy("file", F.col("owner_function").alias("caller"), "object", "function", "resolved_file", "resolved_name", "resolved_class", "resolution").agg(F.count("*").cast("int").alias("n"))


CALLS_SQL = """SELECT * FROM (VALUES ('app.py', 'main', NULL, 'Store', 'shop/store.py', 'Store', NULL, 'import', 1), ('app.py', 'main', NULL, 'check', 'shop/tools.py', 'check', NULL, 'import', 1),
('app.py', 'main', 'shop', 'save', 'shop/store.py', 'save', 'Store', 'typed-receiver', 1), ('app.py', 'main', NULL, 'len', NULL, NULL, NULL, 'builtin', 1), ('shop/base.py', 'log', NULL, 'print', NULL, NULL, NULL, 'builtin', 1),
('shop/base.py', 'load', NULL, 'NotImplementedError', NULL, NULL, NULL, 'builtin', 1), ('shop/store.py', 'save', 'tools', 'check', 'shop/tools.py', 'check', NULL, 'imported-object', 1),
('shop/store.py', 'save', 'self', 'log', 'shop/base.py', 'log', 'Base', 'typed-receiver', 1), ('shop/store.py', 'save', 'self', 'load', 'shop/store.py', 'load', 'Store', 'typed-receiver', 1),
('shop/store.py', 'load', 'self.db', 'execute', NULL, NULL, NULL, NULL, 1), ('shop/tools.py', 'twice', NULL, 'check', 'shop/tools.py', 'check', NULL, 'local', 2),
('tests/test_store.py', 'test_save', NULL, 'Store', 'shop/store.py', 'Store', NULL, 'import', 1), ('tests/test_store.py', 'test_save', 'store', 'save', 'shop/store.py', 'save', 'Store', 'typed-receiver', 1),
('web/routes.js', NULL, NULL, 'require', NULL, NULL, NULL, 'builtin', 2), ('web/users.js', NULL, NULL, 'require', NULL, NULL, NULL, 'builtin', 1),
('web/users.js', 'find', 'db', 'query', 'web/db.js', 'query', NULL, 'imported-object', 1), ('web/users.js', 'create', NULL, 'store', 'web/users.js', 'store', NULL, 'local', 1))
t(file, caller, object, function, resolved_file, resolved_name, resolved_class, resolution, n)"""


def _edges(g: B.Graph) -> DataFrame:
    end = lambda n: F.concat_ws(":", f"{n}.file", f"{n}.class", f"{n}.function", f"{n}.method", f"{n}.route", f"{n}.model")
    return g.execution_edges.select("edge_type", end("src").alias("src"), end("dst").alias("dst"), "is_test", "confidence").distinct()


def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(graph_of(spark))


EDGES_SQL = """SELECT * FROM (VALUES ('DB_ACCESS', 'shop/store.py:Store:load', 'items', false, 'resolved'), ('DB_ACCESS', 'web/users.js:find', 'users', false, 'resolved'),
('FUNCTION_CALL', 'app.py:main', 'shop/store.py:Store', false, 'resolved'), ('FUNCTION_CALL', 'app.py:main', 'shop/store.py:Store:__init__', false, 'resolved'), ('FUNCTION_CALL', 'app.py:main', 'shop/store.py:Store:save', false, 'resolved'),
('FUNCTION_CALL', 'app.py:main', 'shop/tools.py:check', false, 'resolved'), ('FUNCTION_CALL', 'shop/base.py:Base:load', 'shop/store.py:Store:load', false, 'candidates'),
('FUNCTION_CALL', 'shop/store.py:Store:save', 'shop/base.py:Base:log', false, 'resolved'), ('FUNCTION_CALL', 'shop/store.py:Store:save', 'shop/store.py:Store:load', false, 'resolved'),
('FUNCTION_CALL', 'shop/store.py:Store:save', 'shop/tools.py:check', false, 'resolved'), ('FUNCTION_CALL', 'shop/tools.py:twice', 'shop/tools.py:check', false, 'resolved'),
('FUNCTION_CALL', 'tests/test_store.py:test_save', 'shop/store.py:Store', true, 'resolved'), ('FUNCTION_CALL', 'tests/test_store.py:test_save', 'shop/store.py:Store:__init__', true, 'resolved'),
('FUNCTION_CALL', 'tests/test_store.py:test_save', 'shop/store.py:Store:save', true, 'resolved'), ('FUNCTION_CALL', 'web/users.js:find', 'web/db.js:query', false, 'resolved'),
('FUNCTION_CALL', 'web/users.js:create', 'web/users.js:store', false, 'resolved'), ('ROUTE_CALL', 'web/routes.js:GET:/users/:id', 'web/users.js:find', false, 'resolved'),
('ROUTE_CALL', 'web/routes.js:POST:/users', 'web/users.js:create', false, 'resolved')) t(edge_type, src, dst, is_test, confidence)"""


def build_data_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which argument of a call lands in which parameter of the function it resolves to."""
    return graph_of(spark).data_flow.select("source_file", "source_function", "source", "target_file", "target_function", "target_param").distinct()


FLOW_SQL = """SELECT * FROM (VALUES ('app.py', 'main', 'check(1)', 'shop/store.py', 'save', 'item'), ('app.py', 'main', '1', 'shop/tools.py', 'check', 'item'), ('shop/store.py', 'save', 'item', 'shop/tools.py', 'check', 'item'),
('shop/store.py', 'save', 'checked', 'shop/base.py', 'log', 'text'), ('shop/store.py', 'save', 'checked', 'shop/store.py', 'load', 'key'), ('shop/tools.py', 'twice', 'item', 'shop/tools.py', 'check', 'item'),
('shop/tools.py', 'twice', 'check(item)', 'shop/tools.py', 'check', 'item'), ('tests/test_store.py', 'test_save', '1', 'shop/store.py', 'save', 'item'),
('web/users.js', 'find', '''SELECT * FROM users WHERE id = '' + id', 'web/db.js', 'query', 'sql'), ('web/users.js', 'create', 'req.body', 'web/users.js', 'store', 'body'))
t(source_file, source_function, source, target_file, target_function, target_param)"""


def build_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untrusted input that reaches a query in the same function without a sanitizer."""
    return graph_of(spark).security_findings.select("type", "severity", "file", "source", "sink", "model", "target_function")


FINDINGS_SQL = "SELECT 'TAINTED_DB_ACCESS' AS type, 'HIGH' AS severity, 'web/users.js' AS file, 'req.query.id' AS source, 'query' AS sink, 'users' AS model, 'find' AS target_function"


def build_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark).parameters.select("file", "function", "class", "pos", "group_type", "name")


PARAMETERS_SQL = """SELECT file, function, class, pos, 'positional' AS group_type, name FROM (VALUES ('shop/base.py', 'log', 'Base', 0, 'text'), ('shop/base.py', 'load', 'Base', 0, 'key'), ('shop/store.py', '__init__', 'Store', 0, 'db'),
('shop/store.py', 'save', 'Store', 0, 'item'), ('shop/store.py', 'load', 'Store', 0, 'key'), ('shop/tools.py', 'check', NULL, 0, 'item'), ('shop/tools.py', 'twice', NULL, 0, 'item'), ('web/users.js', 'find', NULL, 0, 'req'),
('web/users.js', 'find', NULL, 1, 'res'), ('web/users.js', 'create', NULL, 0, 'req'), ('web/users.js', 'create', NULL, 1, 'res'), ('web/users.js', 'store', NULL, 0, 'body'), ('web/db.js', 'query', NULL, 0, 'sql')) t(file, function, class, pos, name)"""


def build_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that leads to tools.check, tests included."""
    target = spark.range(1).select(F.lit(0).cast("bigint").alias("seed_id"), node("FUNCTION", file="shop/tools.py", function="check").alias("node"))
    return I.upstream(graph_of(spark).execution_edges, target, include_tests=True).select("depth", F.concat_ws(":", "src.file", "src.class", "src.function").alias("src")).distinct()


IMPACT_SQL = """SELECT * FROM (VALUES (1, 'app.py:main'), (1, 'shop/store.py:Store:save'), (1, 'shop/tools.py:twice'), (2, 'app.py:main'), (2, 'tests/test_store.py:test_save')) t(depth, src)"""


def build_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that an edit takes away and adds: both trees are built whole."""
    before, after = _edges(graph_of(spark)), _edges(graph_of(spark, "edited"))
    return before.subtract(after).withColumn("change", F.lit("removed")).unionByName(after.subtract(before).withColumn("change", F.lit("added"))).select("change", "edge_type", "src", "dst")


DIFF_SQL = """SELECT * FROM (VALUES ('removed', 'FUNCTION_CALL', 'app.py:main', 'shop/tools.py:check'), ('removed', 'FUNCTION_CALL', 'shop/store.py:Store:save', 'shop/tools.py:check'), ('removed', 'FUNCTION_CALL', 'shop/tools.py:twice', 'shop/tools.py:check'),
('added', 'FUNCTION_CALL', 'shop/store.py:Store:save', 'shop/tools.py:verify'), ('added', 'FUNCTION_CALL', 'shop/tools.py:twice', 'shop/tools.py:verify')) t(change, edge_type, src, dst)"""

def build_dependency_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy over the edges that imports make, around one file."""
    g = graph_of(spark)
    target = spark.range(1).select(F.lit(0).cast("bigint").alias("seed_id"), node("FILE", file="shop/store.py").alias("node"))
    found = I.resolve_impact(g.execution_edges.unionByName(B.import_edges(g.imports)), target, "DEPENDENCY_ONLY", include_tests=True)
    return found.select("direction", "depth", "edge_type", F.col("src.file").alias("src"), F.col("dst.file").alias("dst"))


DEPENDENCY_SQL = """SELECT *, 1 AS depth, 'IMPORT' AS edge_type FROM (VALUES ('up', 'shop/__init__.py', 'shop/store.py'), ('up', 'tests/test_store.py', 'shop/store.py'), ('down', 'shop/store.py', 'shop/base.py'),
('down', 'shop/store.py', 'shop/tools.py')) t(direction, src, dst)"""

QUERIES = {"build_functions": build_functions, "build_imports": build_imports, "build_calls": build_calls, "build_edges": build_edges, "build_data_flow": build_data_flow, "build_findings": build_findings, "build_parameters": build_parameters, "build_impact": build_impact, "build_diff": build_diff, "build_dependency_only": build_dependency_only}
ORACLE = {"build_functions": FUNCTIONS_SQL, "build_imports": IMPORTS_SQL, "build_calls": CALLS_SQL, "build_edges": EDGES_SQL, "build_data_flow": FLOW_SQL, "build_findings": FINDINGS_SQL, "build_parameters": PARAMETERS_SQL, "build_impact": IMPACT_SQL, "build_diff": DIFF_SQL, "build_dependency_only": DEPENDENCY_SQL}
