"""The engine over HTTP: POST /impact, /context, /validate and /rebuild with JSON, and GET /tools; answers are JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock

from .operators.patches import parses

#: What a client may call, with the names of its arguments.
TOOLS = {
    "impact": ["target", "policy", "max_depth", "direction", "include_tests", "min_confidence"], "neighbors": ["target", "hops", "include_tests", "limit"], "tests_for": ["target", "hops", "limit"],
    "file_dependents": ["file", "hops", "limit"], "find_symbols": ["query", "limit", "include_tests"], "query_context": ["target", "policy"], "skeleton": ["file", "max_symbols"], "expand": ["file", "function"],
    "routes": [], "metrics": [], "build_graph": ["force"],
}
ROUTES = {"/impact": "impact", "/context": "query_context", "/rebuild": "build_graph"}


def call(engine, name: str, given: dict):
    """The answer of a tool. `target` goes first; arguments that a tool doesn't have are an error."""
    if name not in TOOLS:
        raise KeyError(f"unknown tool: {name}")
    if unknown := sorted(set(given) - set(TOOLS[name])):
        raise TypeError(f"{name} has no argument {', '.join(unknown)}")
    first = [given[k] for k in TOOLS[name][:1] if k in given and k != "force"]
    rest = {k: v for k, v in given.items() if k not in TOOLS[name][:1] or k == "force"}
    return getattr(engine, name)(*first, **rest)


def answer(engine, path: str, given: dict) -> tuple[int, dict]:
    """Status and body for a request."""
    try:
        if path == "/tools":
            return 200, {"tools": TOOLS}
        if path == "/validate":
            return 200, {"valid": parses(given.get("file", ""), given.get("code", ""))}
        name = ROUTES.get(path) or (path.removeprefix("/tools/") if path.startswith("/tools/") else None)
        if name is None:
            return 404, {"error": f"no such path: {path}"}
        if name == "build_graph" and path == "/rebuild":
            given = {"force": True}
        return 200, {"result": call(engine, name, given)}
    except (KeyError, TypeError, ValueError) as wrong:
        return 400, {"error": str(wrong).strip("'\""), "candidates": getattr(wrong, "candidates", [])}


def serve(engine, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to run (serve_forever); builds exclude each other."""
    lock = Lock()

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                given = json.loads(self.rfile.read(size) or b"{}")
            except ValueError:
                given = None
            if isinstance(given, dict):
                with lock:
                    status, body = answer(engine, self.path.split("?")[0], given)
            else:
                status, body = 400, {"error": "the body must be a JSON object"}
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = reply

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
