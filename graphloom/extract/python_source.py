"""Matches of Python source, from the standard library's parser."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

# Methods of routers, of database handles, and of HTTP clients.
ROUTE_VERBS = ("get", "post", "put", "patch", "delete", "route", "head", "options")
DB_VERBS = ("execute", "executemany", "find", "find_one", "insert_one", "insert_many", "update_one", "update_many", "delete_one", "delete_many", "aggregate", "query")
PROTOCOL = {ast.For: "__iter__", ast.AsyncFor: "__aiter__"}


class _Extractor(ast.NodeVisitor):
    def __init__(self, file: str, source: str, is_test: bool):
        self.file, self.source, self.is_test = file, source, is_test
        self.rows: list[dict] = []
        self.scopes: list[tuple[str, str, int]] = []  # kind, name, line
        lines = source.encode().split(b"\n")
        self.offsets = [0]
        for line in lines:
            self.offsets.append(self.offsets[-1] + len(line) + 1)

    def text(self, node: ast.AST | None) -> str:
        return "" if node is None else ast.unparse(node)

    def owner(self) -> tuple[str | None, int | None, str | None]:
        function = next(((n, at) for k, n, at in reversed(self.scopes) if k == "function"), (None, None))
        cls = next((n for k, n, _ in reversed(self.scopes) if k == "class"), None)
        return function[0], function[1], cls

    def scope(self) -> str:
        return "/".join(f"{n}:{at}" for _, n, at in self.scopes) or "GLOBAL"

    def add(self, match_type: str, node: ast.AST, /, **captures) -> None:
        function, line, cls = self.owner()
        start = self.offsets[node.lineno - 1] + node.col_offset
        end = self.offsets[node.end_lineno - 1] + node.end_col_offset
        held = {k: [str(x) for x in (v if isinstance(v, list) else [v])] for k, v in captures.items() if v not in (None, "", [])}
        self.rows.append({"match_type": match_type, "file": self.file, "captures": held, "owner_function": function, "owner_line": line, "owner_class": cls, "scope_id": self.scope(), "start_line": node.lineno, "end_line": node.end_lineno, "start_byte": start, "end_byte": end, "is_test": self.is_test, "seq": len(self.rows)})

    def call_id(self, node: ast.AST) -> str:
        return f"{self.file}:{self.offsets[node.lineno - 1] + node.col_offset}:{self.offsets[node.end_lineno - 1] + node.end_col_offset}"

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("IMPORT", node, source=a.name, local=a.asname or a.name.split(".")[0], name="*module*")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        source = "." * node.level + (node.module or "")
        for a in node.names:
            kind = "star" if a.name == "*" else None
            self.add("IMPORT", node, source=source, local=a.asname or a.name, name=a.name, star=kind)
            if self.file.endswith("__init__.py"):
                self.add("REEXPORT", node, source=source, exported=a.asname or a.name, original=a.name, star=kind)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        fields = [f"{t.target.id}={self.text(t.annotation)}" for t in node.body if isinstance(t, ast.AnnAssign) and isinstance(t.target, ast.Name)]
        attrs = [t.id for b in node.body if isinstance(b, ast.Assign) for t in b.targets if isinstance(t, ast.Name)]
        bases = [self.text(b) for b in node.bases]
        self.add("CLASS_DEF", node, name=node.name, superclass=bases[0] if bases else None, interfaces=bases[1:], fields=fields, attrs=attrs, decorators=[self.text(d) for d in node.decorator_list])
        self.scopes.append(("class", node.name, node.lineno))
        for b in node.body:
            if isinstance(b, (ast.Assign, ast.AnnAssign)):
                for t in b.targets if isinstance(b, ast.Assign) else [b.target]:
                    if isinstance(t, ast.Name):
                        self.add("CONSTANT", b, name=t.id, value=self.text(b.value), kind="class_attribute")
            self.visit(b)
        self.scopes.pop()

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        decorators = [self.text(d) for d in node.decorator_list]
        own, _, _ = self.owner()
        in_class = bool(self.scopes) and self.scopes[-1][0] == "class"
        doc = ast.get_docstring(node) or ""
        returns = self.text(node.returns).strip("'\"") or (m[1] if (m := re.search(r"(?m)^\s*(?::rtype:|Returns?:?\s*\n?[-\s]*)\s*([A-Z]\w*)", doc)) else "")
        self.add(
            "FUNCTION_DEF", node, name=node.name, parent=None if in_class else own, is_method="true" if in_class else None, is_async="true" if isinstance(node, ast.AsyncFunctionDef) else None,
            static="true" if any(d in ("staticmethod", "classmethod") for d in decorators) else None, fixture=node.name if any("fixture" in d for d in decorators) else None, return_type=returns, decorators=decorators, doc=doc.split("\n")[0][:200],
        )
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTE_VERBS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                methods = next((self.text(k.value) for k in d.keywords if k.arg == "methods"), None)
                verbs = re.findall(r"[A-Z]+", methods) if methods else ["GET" if d.func.attr == "route" else d.func.attr.upper()]
                for verb in verbs:
                    self.add("ROUTE", node, method=verb, path=d.args[0].value, router=self.text(d.func.value), handler=node.name)
            self.visit(d)
        self.scopes.append(("function", node.name, node.lineno))
        a = node.args
        places = [*a.posonlyargs, *a.args]
        skip = 1 if in_class and places and "staticmethod" not in decorators else 0
        for pos, p in enumerate(places[skip:]):
            self.add("PARAMETER", p, name=p.arg, pos=str(pos), group="positional", type=self.text(p.annotation).strip("'\""))
        if a.vararg:
            self.add("PARAMETER", a.vararg, name=a.vararg.arg, pos=str(len(places) - skip), group="rest")
        for p in a.kwonlyargs:
            self.add("PARAMETER", p, name=p.arg, pos="-1", group="keyword", type=self.text(p.annotation).strip("'\""))
        if a.kwarg:
            self.add("PARAMETER", a.kwarg, name=a.kwarg.arg, pos="-1", group="keywords")
        for default in [*a.defaults, *a.kw_defaults]:
            if default is not None:
                self.visit(default)
        for b in node.body:
            self.visit(b)
        self.scopes.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        receiver, name = (self.text(f.value), f.attr) if isinstance(f, ast.Attribute) else (None, f.id if isinstance(f, ast.Name) else None)
        call = self.call_id(node)
        if name:
            self.add("CALL", node, call_id=call, name=name, receiver=receiver, args=str(len(node.args)))
            for pos, arg in enumerate(node.args):
                self.add("ARGUMENT", arg, call_id=call, function=name, pos=str(pos), value=self.text(arg))
            for k in node.keywords:
                if k.arg:
                    self.add("ARGUMENT", k.value, call_id=call, function=name, pos="-1", keyword=k.arg, value=self.text(k.value))
            if receiver and name in DB_VERBS and node.args:
                first = self.text(node.args[0])
                table = re.search(r"(?i)\b(?:from|into|update|table)\s+[`\"']?(\w+)", first)
                self.add("DATABASE_OP", node, operation=name, model=table[1] if table else receiver.split(".")[-1], query=first if table else None, connection=receiver)
            if receiver in ("requests", "httpx", "session", "client") and name in ROUTE_VERBS and node.args:
                self.add("HTTP_CALL", node, method=name.upper(), path=self.text(node.args[0]).strip("'\""))
        elif isinstance(f, ast.Subscript):
            self.add("CALL", node, call_id=call, name=self.text(f.value), dispatch="table", key=self.text(f.slice))
        if isinstance(f, ast.Name) and f.id == "getattr" and len(node.args) > 1:
            self.add("CALL", node, call_id=call, name="getattr", dispatch="getattr", key=self.text(node.args[1]))
        self.generic_visit(node)

    def _assign(self, node, targets, value, annotation=None) -> None:
        for t in targets:
            names = t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]
            if len(names) > 1:
                for pos, n in enumerate(names):
                    self.add("DESTRUCTURE", node, local=self.text(n), source=self.text(value), pos=str(pos))
                continue
            name = self.text(names[0])
            if isinstance(value, ast.Name):
                self.add("ALIAS", node, alias=name, original=value.id)
            made = value.func if isinstance(value, ast.Call) else None
            kind = self.text(annotation).strip("'\"") if annotation is not None else (self.text(made).split(".")[-1] if made is not None and self.text(made).split(".")[-1][:1].isupper() else None)
            if kind:
                self.add("VARIABLE_TYPE", node, variable=name, type=kind)
            elif made is not None:
                self.add("VARIABLE_TYPE", node, variable=name, from_call=self.call_id(value))
            if isinstance(value, ast.Dict) and value.values and all(isinstance(v, ast.Name) for v in value.values):
                self.add("CONSTANT", node, name=name, kind="dispatch_table", targets=[v.id for v in value.values])
            self.add("VARIABLE_STATE", node, variable=name, value=self.text(value))
            if not self.scopes and isinstance(names[0], ast.Name):
                self.add("CONSTANT", node, name=name, value=self.text(value), kind="module")

    def visit_Assign(self, node: ast.Assign) -> None:
        self._assign(node, node.targets, node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value is not None or self.scopes:
            self._assign(node, [node.target], node.value or ast.Constant(None), node.annotation)
        self.generic_visit(node)

    def visit_Return(self, node: ast.Return) -> None:
        if node.value is not None:
            self.add("RETURN_VALUE", node, value=self.text(node.value), from_call=self.call_id(node.value) if isinstance(node.value, ast.Call) else None)
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        if node.exc is not None:
            self.add("ERROR", node, throw=self.text(node.exc))
        self.generic_visit(node)

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str):
            self.add("LITERAL", node, text=node.value)

    def _implicit(self, node: ast.AST, target: ast.AST, method: str) -> None:
        if isinstance(target, (ast.Name, ast.Attribute)):
            self.add("CALL", node, call_id=self.call_id(target) + f":{method}", name=method, receiver=self.text(target), implicit="true")

    def visit_For(self, node: ast.For) -> None:
        self._implicit(node.iter, node.iter, "__iter__")
        self.generic_visit(node)

    def visit_With(self, node: ast.With) -> None:
        for item in node.items:
            self._implicit(item.context_expr, item.context_expr, "__enter__")
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if isinstance(node.ctx, ast.Load):
            self._implicit(node, node.value, "__getitem__")
        self.generic_visit(node)


def extract(file: str, source: str, is_test: bool = False) -> Iterator[dict]:
    """Matches of a file; none if it can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return iter(())
    own = _Extractor(file, source, is_test)
    own.visit(tree)
    return iter(own.rows)
