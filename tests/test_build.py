"""From a source tree to a graph, on small repositories written for these tests."""

import pytest
from pyspark.sql import functions as F

from graphloom.extract import brace_source, python_source
from graphloom.extract.schema import MATCHES
from graphloom.operators import build as B
from graphloom.operators import impact
from graphloom.operators.symbols import TargetError, resolve_target
from graphloom.plans.nodes import node
from graphloom.sources import files as S

REPO = {
    "shop/__init__.py": "from .store import Store\nfrom .tools import *\n",
    "shop/store.py": '''
from .base import Base
from . import tools
import requests


class Store(Base):
    def __init__(self, db):
        self.db = db

    def save(self, item):
        checked = tools.check(item)
        self.log(checked)
        item = self.level
        self.db.execute("INSERT INTO items VALUES (1)")
        return requests.post("http://x/y")

    def load(self, key):
        return self.db.execute("SELECT * FROM items")


def make_store() -> Store:
    return Store(None)
''',
    "shop/base.py": '''
class Base:
    level = 1

    def log(self, text):
        print(text)

    def load(self, key):
        raise NotImplementedError("load it")
''',
    "shop/tools.py": '''
def check(item):
    def inner(x):
        return x
    return inner(item)


def read(req):
    name = req.args["name"]
    return name


HANDLERS = {"a": check, "b": read}
LIMIT = 3


def run(key):
    again = read
    again(LIMIT)
    return HANDLERS[key](1)
''',
    "app.py": '''
from flask import Flask
from shop import Store, check
from shop.store import make_store

app = Flask(__name__)


@app.route("/items", methods=["POST"])
def create(req):
    name = req.form["name"]
    store = make_store()
    store.save(name)
    return check(name)
''',
    "tests/conftest.py": "import pytest\n\n\n@pytest.fixture\ndef shelf():\n    return 1\n",
    "tests/test_store.py": "from shop.store import make_store\n\n\ndef test_save(shelf):\n    store = make_store()\n    store.save(3)\n",
    "web/api.js": '''
import { handler } from './handler.js';
const express = require('express');
const router = express.Router();
router.get('/users/:id', auth, handler);
class Service extends Base {
  constructor(db) { this.db = db; }
  async find({ id, name }, ...rest) { return this.db.findOne({ id }); }
}
''',
    "web/handler.js": "export function handler(req, res) {\n  const id = req.params.id;\n  const s = new Service();\n  return helper(id);\n}\nconst helper = (x) => x + 1;\n",
    "broken.py": "def oops(:\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in {**REPO, "node_modules/x/y.js": "function no() {}", "lib/z.min.js": "function no() {}", "notes.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return S.repo_files(spark, str(root))


@pytest.fixture(scope="module")
def graph(tree):
    return B.build(tree, S.read_matches(tree))


def test_scan_prunes(tree):
    got = {r.file: r.is_test for r in tree.collect()}
    assert set(got) == set(REPO) and sorted(f for f, t in got.items() if t) == ["tests/conftest.py", "tests/test_store.py"]


def test_modules_resolve(graph):
    got = {(r.file, r.local): r.resolved_file for r in graph.imports.collect()}
    assert got[("shop/store.py", "Base")] == "shop/base.py"
    assert got[("shop/store.py", "tools")] == "shop/tools.py"
    assert got[("shop/store.py", "requests")] is None
    assert got[("app.py", "Store")] == "shop/__init__.py" and got[("app.py", "make_store")] == "shop/store.py"
    assert got[("web/api.js", "handler")] == "web/handler.js" and got[("web/api.js", "express")] is None


def calls_of(graph, file):
    return {(r.owner_function, r.object, r.function): (r.resolved_file, r.resolved_class, r.resolution) for r in graph.calls.where(F.col("file") == file).collect()}


def test_calls_resolve(graph):
    store, app = calls_of(graph, "shop/store.py"), calls_of(graph, "app.py")
    assert store[("save", "tools", "check")] == ("shop/tools.py", None, "imported-object")
    assert store[("save", "self", "log")] == ("shop/base.py", "Base", "typed-receiver")
    assert store[("save", "requests", "post")][2] == "external"
    assert store[("make_store", None, "Store")] == ("shop/store.py", None, "local")
    assert app[("create", None, "make_store")][0] == "shop/store.py"
    assert app[("create", None, "check")][:1] == ("shop/tools.py",)  # through a star re-export
    assert app[("create", "store", "save")] == ("shop/store.py", "Store", "typed-receiver")  # by the declared return type


def names(edges):
    return {(r.edge_type, r.src.function or r.src.route, r.dst.function or r.dst.model, r.confidence) for r in edges.collect()}


def test_edges(graph):
    got = names(graph.execution_edges)
    assert ("FUNCTION_CALL", "create", "save", "resolved") in got
    assert ("FUNCTION_CALL", "make_store", "__init__", "resolved") in got
    assert ("FUNCTION_CALL", "load", "load", "candidates") in got
    assert ("FUNCTION_CALL", "check", "inner", "resolved") in got and ("FUNCTION_CALL", "check", "inner", "nested") not in got
    assert ("FUNCTION_CALL", "run", "check", "dispatch") in got and ("FUNCTION_CALL", "run", "read", "dispatch") in got
    assert ("ROUTE_CALL", "/items", "create", "resolved") in got and ("ROUTE_CALL", "/users/:id", "handler", "resolved") in got
    assert ("ROUTE_MIDDLEWARE", "/users/:id", "auth", "resolved") in got
    assert ("DB_ACCESS", "save", "items", "resolved") in got and ("DB_ACCESS", "find", "db", "resolved") in got
    assert ("FUNCTION_CALL", "handler", "helper", "resolved") in got


def test_linked_edges(graph):
    got = names(graph.execution_edges)
    assert ("FUNCTION_CALL", "save", "level", "uses") in got  # an attribute of the base class
    assert ("FUNCTION_CALL", "run", "LIMIT", "uses") in got and ("FUNCTION_CALL", "run", "HANDLERS", "uses") in got
    assert ("FUNCTION_CALL", "test_save", "shelf", "convention") in got
    assert ("FUNCTION_CALL", "run", "read", "candidates") in got


def test_near_declarations(spark, graph):
    from graphloom.operators.link import near_declarations

    line = {r.name: r.start_line for r in graph.functions.where("file = 'shop/tools.py'").collect()}
    found = spark.createDataFrame([(1, "shop/tools.py", line["check"]), (2, "shop/tools.py", line["read"] - 1), (3, "shop/tools.py", 900)], "id int, file string, line int")
    assert {r.id: r.name for r in near_declarations(found, graph.functions).collect()} == {1: "check", 2: "read", 3: None}


def test_symbol_kinds(spark, graph):
    from graphloom.operators.context import function_facts, symbol_kinds, unknown_symbols

    asked = spark.createDataFrame([("shop/tools.py", "read", n) for n in ("req", "name", "check", "nothing", "return", "key")], "file string, function string, symbol string")
    got = {r.symbol: r.kinds for r in symbol_kinds(graph, asked).collect()}
    assert got == {"req": ["parameter"], "name": ["local"], "check": ["function"], "nothing": [], "return": ["builtin"], "key": []}
    facts = function_facts(graph, "shop/tools.py", "read")
    assert [r.variable for r in facts["tainted"].collect()] == ["name"] and facts["returns"].count() == 1
    patch = spark.createDataFrame([("shop/tools.py", "read", ["req", "zap", "print"])], "file string, function string, identifiers array<string>")
    assert [r.symbol for r in unknown_symbols(graph, patch).collect()] == ["zap"]


def test_patches(spark, tree):
    from graphloom.operators import patches as P

    block = "<<<<<<< SEARCH\nLIMIT = 3\n=======\nLIMIT = (\n>>>>>>> REPLACE"
    diff = "--- a\n+++ b\n@@ -900,1 +1,2 @@\n-LIMIT = 3\n+LIMIT = 4\n+MORE = 5\n@@ -1 +1 @@\n-nowhere\n+x\n"
    rows = [(1, "shop/tools.py", block), (2, "shop/tools.py", diff), (3, "new.js", "<<<<<<< SEARCH\n=======\nf({a: [1]}); // )\n>>>>>>> REPLACE")]
    got = {r.patch_id: r for r in P.patched(tree, spark.createDataFrame(rows, "patch_id int, file string, patch string")).collect()}
    assert (got[1].lost, got[1].valid) == (0, False) and (got[2].lost, got[2].valid) == (1, True) and "MORE = 5" in got[2].content
    assert got[3].valid and "f({a" in got[3].content and not P.parses("a.js", "f(]")


def test_report(spark):
    from graphloom.reports import report

    assert "| 1 | a\\|b |" in report("T", some_part=spark.createDataFrame([(1, "a|b")], "x int, y string"))


def test_impact_on_the_tree(spark, graph):
    target = spark.range(1).select(F.lit(0).cast("bigint").alias("seed_id"), node("FUNCTION", file="shop/store.py", function="save", class_="Store").alias("node"))
    tests = impact.tests_for(graph.execution_edges, target, graph.functions.where("is_test").select("file"))
    assert [(r.file, r.function, r.depth) for r in tests.collect()] == [("tests/test_store.py", "test_save", 1)]
    slice_ = names(impact.resolve_impact(graph.execution_edges, target, "NEW_FEATURE"))
    assert {("ROUTE_CALL", "/items", "create", "resolved"), ("FUNCTION_CALL", "create", "save", "resolved"), ("DB_ACCESS", "save", "items", "resolved")} <= slice_
    imports = graph.imports.select("file", "resolved_file", "is_test")
    deps = {(r.file, r.depth, r.is_test) for r in impact.file_dependents(imports, spark.createDataFrame([("shop/store.py",)], "file string")).collect()}
    assert ("app.py", 1, False) in deps and ("tests/test_store.py", 1, True) in deps


def test_security(graph):
    assert ("create", "name") in {(r.target_function, r.target_param) for r in graph.taint_sources.collect()}
    assert ("save", "item") in {(r.target_function, r.target_param) for r in graph.taint_sources.where("type = 'USER_INPUT'").collect()}
    assert ("save", "items") in {(r.target_function, r.model) for r in graph.security_findings.collect()}
    assert ("read", "name") in {(r.target_function, r.target_param) for r in graph.taint_sources.where("type = 'RETURN_TAINT'").collect()}


def test_targets(graph):
    assert resolve_target(graph.functions, "FUNCTION:make_store")["file"] == "shop/store.py"
    assert resolve_target(graph.functions, "FUNCTION:shop/store.py:Store.load")["class"] == "Store"
    assert resolve_target(graph.functions, "ROUTE:post:/items")["method"] == "POST"
    with pytest.raises(TargetError) as wrong:
        resolve_target(graph.functions, "FUNCTION:load")
    assert len(wrong.value.candidates) == 2


def test_quality(graph):
    rows = {r.receiver: r for r in B.resolution_metrics(graph.calls).collect()}
    assert sum(r.calls for r in rows.values()) == graph.calls.count() and rows["bare"].percent >= 80


def test_extractors_give_nothing_for_broken_text():
    assert list(python_source.extract("a.py", "def (:")) == [] and list(brace_source.extract("a.js", "")) == []
    assert list(brace_source.extract("a.js", "function ( { ) [ '")) is not None


def test_brace_extractor_on_java():
    rows = list(brace_source.extract("a/B.java", 'package a;\nimport java.util.List;\n@RestController\npublic class B extends C implements D, E {\n  private Repo repo;\n  @GetMapping("/x")\n  public String get(Long id) { Repo r = new Repo(); return r.find(id); }\n}\n'))
    by = lambda kind: [r for r in rows if r["match_type"] == kind]
    assert by("CLASS_DEF")[0]["captures"]["superclass"] == ["C"] and by("CLASS_DEF")[0]["captures"]["interfaces"] == ["D", "E"]
    assert by("FUNCTION_DEF")[0]["captures"]["name"] == ["get"] and by("FUNCTION_DEF")[0]["owner_class"] == "B"
    assert by("PARAMETER")[0]["captures"]["type"] == ["Long"]
    assert ("r", "find") in {(r["captures"].get("receiver", [None])[0], r["captures"]["name"][0]) for r in by("CALL")}
    assert by("VARIABLE_TYPE")[0]["captures"]["type"] == ["Repo"]


def test_changed_lines(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@ def f\n a\n-b\n+c\n+d\n e\n@@ -10 +11 @@\n-q\n+r\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
    got = sorted((r.file, r.line) for r in S.changed_lines(spark.createDataFrame([(diff,)], "diff string")).collect())
    assert got == [("x.py", 2), ("x.py", 3), ("x.py", 11)]


def test_names_taken_out_of_an_object(spark):
    files = spark.createDataFrame([("a.js", "const users = require('./b');\nconst { find, drop: gone } = users;\n\nfunction go() {\n  find(1);\n  gone();\n}\n", False), ("b.js", "function find(id) {\n  return id;\n}\n\nfunction drop() {\n  return 0;\n}\n\nmodule.exports = { find, drop };\n", False)], "file string, content string, is_test boolean")
    calls = B.build(files, S.read_matches(files)).calls.where("owner_function = 'go'")
    assert {(r.object, r.function, r.resolved_file, r.resolution) for r in calls.collect()} == {("users", "find", "b.js", "imported-object"), ("users", "drop", "b.js", "imported-object")}


def test_engine_answers(spark, tree, tmp_path_factory):
    from graphloom.api import Engine

    root = tmp_path_factory.mktemp("engine")
    for name, text in REPO.items():
        (root / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "src" / name).write_text(text)
    engine = Engine(spark, str(root / "src"), str(root / "snapshot"))
    assert engine.build_graph()["built"] and not engine.build_graph()["built"]
    up = engine.impact("FUNCTION:shop/tools.py:check")
    assert {"save", "create"} <= {e["src"]["function"] for e in up["upstream"]} and up["completeness"]["verdict"] == "complete"
    assert [t["function"] for t in engine.tests_for("FUNCTION:shop/store.py:Store.save")] == ["test_save"]
    assert engine.find_symbols("where is make_store defined")[0]["file"] == "shop/store.py"
    context = engine.query_context("FUNCTION:shop/store.py:Store.save")[0]
    assert any("INSERT INTO items" in s["code"] for s in context["snippets"]) and 0 < context["percent_less"] < 100
    assert engine.expand("shop/tools.py", "read")[0].startswith("def read(req):")
    assert {r["path"] for r in engine.routes()} == {"/items", "/users/:id"} and engine.metrics()["routes"] == 2
    (root / "src/shop/tools.py").write_text(REPO["shop/tools.py"] + "\n\ndef extra():\n    return check(1)\n")
    assert engine.build_graph()["changed"] == ["shop/tools.py"]
    assert {"extra"} <= {e["src"]["function"] for e in engine.impact("FUNCTION:shop/tools.py:check")["upstream"]}


def test_long_source_texts_are_whole(spark):
    """What stands after many characters of a value, argument, return, handler or query counts like what stands before."""
    filler = ", ".join(f"k{i}: {i}" for i in range(200))
    script = f"""
function store(item) {{ db.save(item); }}
function late(req) {{ const row = {{ {filler}, body: req.body }}; store({{ {filler}, body: req.body }}); db.query(`SELECT {"x, " * 200} last_column FROM items`); return {{ {filler}, last: 1 }}; }}
function clean(req) {{ const safe = {{ {filler}, early: req.body, late: sanitize(req.query) }}; db.save(safe); }}
router.get('/x', (req, res) => {{ res.send({{ {filler}, last: 1 }}); }});
"""
    module = f"def late():\n    row = [{', '.join(map(str, range(300)))}, request.args]\n    return [{', '.join(map(str, range(300)))}, 'last']\n"
    rows = [*brace_source.extract("a.js", script), *python_source.extract("b.py", module)]
    g = B.declarations(spark.createDataFrame(rows, MATCHES))
    states = {(r.file, r.variable): (r.tainted, r.sanitized) for r in g["variable_states"].collect()}
    assert states == {("a.js", "row"): (True, False), ("a.js", "safe"): (False, True), ("b.py", "row"): (True, False)}
    assert any("req.body" in r.value for r in g["arguments"].where("function = 'store'").collect())
    assert g["database_ops"].where("operation = 'query'").first().query.endswith("last_column FROM items`")
    assert all("last" in r.value for r in g["returns"].collect()) and g["returns"].count() == 2
    assert "last: 1" in g["routes"].first().handler
