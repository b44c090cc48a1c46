"""Requests over HTTP against an engine that records its calls, and the text functions against their definitions."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from graphloom import server
from graphloom.functions import code


class Recorder:
    def __getattr__(self, name):
        return lambda *args, **more: [name, list(args), more]


@pytest.fixture
def ask():
    own = server.serve(Recorder(), 0)
    threading.Thread(target=own.serve_forever, daemon=True).start()

    def send(path, body=None):
        url = f"http://127.0.0.1:{own.server_address[1]}{path}"
        try:
            with urllib.request.urlopen(urllib.request.Request(url, None if body is None else json.dumps(body).encode())) as got:
                return got.status, json.loads(got.read())
        except urllib.error.HTTPError as wrong:
            return wrong.code, json.loads(wrong.read())

    yield send
    own.shutdown()


def test_requests(ask):
    assert ask("/impact", {"target": "FUNCTION:f", "policy": "DEFAULT"}) == (200, {"result": ["impact", ["FUNCTION:f"], {"policy": "DEFAULT"}]})
    assert ask("/context", {"target": "FUNCTION:f"}) == (200, {"result": ["query_context", ["FUNCTION:f"], {}]})
    assert ask("/rebuild", {})[1] == {"result": ["build_graph", [], {"force": True}]}
    assert ask("/validate", {"file": "a.py", "code": "def f(:"}) == (200, {"valid": False})
    assert ask("/validate", {"file": "a.js", "code": "f({a: [1]})"}) == (200, {"valid": True})
    assert ask("/tools/neighbors", {"target": "FUNCTION:f", "hops": 2})[1] == {"result": ["neighbors", ["FUNCTION:f"], {"hops": 2}]}
    assert set(ask("/tools")[1]["tools"]) == set(server.TOOLS)
    assert ask("/nothing", {})[0] == 404 and ask("/tools/nothing", {})[0] == 400 and ask("/impact", {"depth": 1})[0] == 400 and ask("/impact", [1])[0] == 400


@pytest.mark.parametrize(
    "expr, want",
    [
        ("a.b(c).d(e)", ("a.b(c)", "d", "e")), ("f(x)", (None, "f", "x")), ("await g(h(1), 2)", (None, "g", "h(1), 2")), ("new A(x)", (None, None, None)), ("a.b", (None, None, None)), ("(x)", (None, None, None)),
        ("", (None, None, None)), (None, (None, None, None)), ("f)", (None, None, None)), ("$el.on(() => {})", ("$el", "on", "() => {}")), (" f() ", (None, "f", "")),
    ],
)
def test_calls_are_split(expr, want):
    assert code.call_parts(expr) == want


@pytest.mark.parametrize(
    "text, line, python, want",
    [
        ("def f():\n    '''Does it.'''\n", 1, True, "Does it."), ("def f():\n    \"\"\"\n    Later line.\n    \"\"\"\n", 1, True, "Later line."), ("def f():\n    x = 1\n", 1, True, ""), ("@deco\ndef f(a,\n      b):\n    'no'\n", 2, True, ""),
        ("/** Adds. */\nfunction f() {}", 2, False, "Adds."), ("/*\n * @param x\n * Text here\n */\n\nfunction f() {}", 6, False, "Text here"), ("// one line\nf = 1", 2, False, "one line"), ("x = 1\nfunction f() {}", 2, False, ""), ("function f() {}", 1, False, ""), (None, 1, False, ""),
    ],
)
def test_first_lines_of_docs(text, line, python, want):
    assert code.doc_line(text, line, python) == want
