"""Matches of JavaScript, TypeScript, Java and the like: a tokeniser that knows strings, comments and braces, and declarations found in its tokens."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

TOKEN = re.compile(r"""(?P<space>\s+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$@][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\.\.\.|[-+*/%=!<>&|^?]=|\S)""")
# Words that are followed by a parenthesis without being a call, verbs of routers, and modifiers.
NOT_CALLS = set("if for while switch catch return typeof function await new throw super synchronized do else try case in of delete void yield instanceof".split())
VERBS = set("get post put patch delete head options all use".split())
MODIFIERS = set("public private protected static final abstract async export default readonly override synchronized native get set".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class _Reader:
    def __init__(self, file: str, source: str, is_test: bool):
        self.file, self.source, self.is_test = file, source, is_test
        self.java = file.endswith(".java")
        self.tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(source) if m.lastgroup != "space"]
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.match = self._pairs()
        self.rows: list[dict] = []
        self.spans: list[tuple[int, int, str, str, int]] = []  # first and last token, kind, name, line

    def _pairs(self) -> dict[int, int]:
        stack, out = [], {}
        for i, (kind, text, _, _) in enumerate(self.tokens):
            if kind == "sign" and text in OPEN:
                stack.append((i, OPEN[text]))
            elif kind == "sign" and text in CLOSE:
                while stack and stack[-1][1] != text:
                    stack.pop()
                if stack:
                    out[stack.pop()[0]] = i
        return out

    def text(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return bisect_right(self.breaks, self.tokens[min(i, len(self.tokens) - 1)][2]) + 1

    def between(self, i: int, j: int) -> str:
        return self.source[self.tokens[i][2] : self.tokens[j][3]] if i <= j < len(self.tokens) else ""

    def owner(self, i: int) -> tuple[str | None, int | None, str | None, str]:
        inside = sorted(s for s in self.spans if s[0] < i <= s[1])
        function = next(((n, at) for _, _, k, n, at in reversed(inside) if k == "function"), (None, None))
        cls = next((n for _, _, k, n, _ in reversed(inside) if k == "class"), None)
        return function[0], function[1], cls, "/".join(f"{n}:{at}" for _, _, _, n, at in inside) or "GLOBAL"

    def add(self, kind: str, i: int, j: int, **captures) -> None:
        j = min(j, len(self.tokens) - 1)
        function, line, cls, scope = self.owner(i)
        held = {k: [str(x) for x in (v if isinstance(v, list) else [v])] for k, v in captures.items() if v not in (None, "", [])}
        self.rows.append({"match_type": kind, "file": self.file, "captures": held, "owner_function": function, "owner_line": line, "owner_class": cls, "scope_id": scope, "start_line": self.line(i), "end_line": self.line(j), "start_byte": self.tokens[i][2], "end_byte": self.tokens[j][3], "is_test": self.is_test, "seq": len(self.rows)})

    def parts(self, i: int) -> list[tuple[int, int]]:
        """Token ranges of the comma-separated parts of the bracket at i."""
        end, out, start, j = self.match.get(i, i), [], i + 1, i + 1
        while j < end:
            if j in self.match:
                j = self.match[j]
            elif self.text(j) == ",":
                out.append((start, j - 1))
                start = j + 1
            j += 1
        if start < end:
            out.append((start, end - 1))
        return out

    def declare(self) -> None:
        """First the classes and functions, so that owners are known."""
        n = len(self.tokens)
        for i in range(n):
            kind, word, _, _ = self.tokens[i]
            if kind != "name":
                continue
            if word in ("class", "interface") and i + 1 < n and self.tokens[i + 1][0] == "name":
                body = next((j for j in range(i + 2, min(n, i + 40)) if self.text(j) == "{"), None)
                if body is not None and body in self.match:
                    self.spans.append((i, self.match[body], "class", self.text(i + 1), self.line(i)))
            name, open_at = None, None
            if word == "function" and self.text(i + 1) not in ("(", "*"):
                name, open_at = self.text(i + 1), i + 2
            elif self.text(i + 1) == "(" and word not in NOT_CALLS and not word.startswith("@") and self.text(i - 1) not in (".", "new", "function"):
                name, open_at = word, i + 1
            elif word in ("const", "let", "var") and self.text(i + 2) == "=":
                j = i + 3 + (self.text(i + 3) == "async")
                after = self.match.get(j, j) + 1 if self.text(j) == "(" else j + 1
                if self.text(after) == "=>" or self.text(j) == "function":
                    name, open_at = self.text(i + 1), j if self.text(j) == "(" else j + 1
                    if self.text(after) == "=>":
                        body = after + 1
                        last = self.match.get(body, body) if self.text(body) == "{" else next((x for x in range(body, n) if self.text(x) == ";"), n - 1)
                        self.spans.append((i, last, "function", name, self.line(i)))
                        continue
            if name is None or open_at not in self.match:
                continue
            body = next((j for j in range(self.match[open_at] + 1, min(n, self.match[open_at] + 25)) if self.text(j) in ("{", ";", "=>", ")", ",", "(")), None)
            if body is not None and self.text(body) == "{" and body in self.match:
                self.spans.append((i, self.match[body], "function", name, self.line(i)))

    def read(self) -> list[dict]:
        self.declare()
        classes = {s[0]: s for s in self.spans if s[2] == "class"}
        functions = {s[0]: s for s in self.spans if s[2] == "function"}
        for i, (kind, word, _, _) in enumerate(self.tokens):
            if kind == "string":
                if len(word) > 2:
                    self.add("LITERAL", i, i, text=word[1:-1])
                continue
            if kind != "name":
                continue
            if i in classes:
                self._class(i, classes[i])
            if i in functions:
                self._function(i, functions[i])
            elif word == "import":
                self._import(i)
            elif word == "export" and self.text(i + 1) in ("{", "*"):
                self._reexport(i)
            elif word == "return" and self.text(i + 1) not in (";", "}", ""):
                end = self._statement_end(i)
                self.add("RETURN_VALUE", i, end, value=self.between(i + 1, end))
            elif word == "throw":
                self.add("ERROR", i, self._statement_end(i), throw=self.between(i + 1, self._statement_end(i)))
            elif self.text(i + 1) == "(" and word not in NOT_CALLS and not word.startswith("@") and i + 1 in self.match and not self._declared(i):
                self._call(i, word)
            if word in ("const", "let", "var") or (self.java and self.text(i + 2) == "=" and word[:1].isupper()):
                self._variable(i)
        return self.rows

    def _declared(self, i: int) -> bool:
        """Whether the name at i is that of a function declaration."""
        before = self.text(i - 1)
        return before == "function" or (before == "*" and self.text(i - 2) == "function")

    def _statement_end(self, i: int) -> int:
        j, n = i + 1, len(self.tokens)
        while j < n and self.text(j) not in (";", "}"):
            j = self.match.get(j, j) + 1
        return max(i, min(j, n) - 1)

    def _class(self, i: int, span) -> None:
        head = self.between(i, next(j for j in range(i, span[1]) if self.text(j) == "{") - 1)
        up = re.search(r"\bextends\s+([\w$.]+)", head)
        faces = re.search(r"\bimplements\s+([\w$.,\s<>]+)", head)
        notes = self._annotations(i)
        self.add("CLASS_DEF", i, span[1], name=span[3], superclass=up[1].split(".")[-1] if up else None, interfaces=[re.sub(r"<.*", "", x).strip() for x in faces[1].split(",")] if faces else [], is_interface="true" if self.text(i) == "interface" else None, decorators=notes)

    def _annotations(self, i: int) -> list[str]:
        out, j = [], i - 1
        closed = {v: k for k, v in self.match.items()}
        while j >= 0:
            if self.tokens[j][0] == "name" and self.text(j) in MODIFIERS:
                j -= 1
            elif self.text(j) == ")" and j in closed and self.text(closed[j] - 1).startswith("@"):
                out.append(self.between(closed[j] - 1, j))
                j = closed[j] - 2
            elif self.text(j).startswith("@"):
                out.append(self.text(j))
                j -= 1
            else:
                break
        return out[::-1]

    def _function(self, i: int, span) -> None:
        at = next((j for j in range(i, span[1] + 1) if self.text(j) == "("), None)
        own, _, cls, _ = self.owner(i)
        parent = own if self.text(i) in ("function", "const", "let", "var") else None
        before = {self.text(j) for j in range(max(0, i - 4), i)} & MODIFIERS
        kept = self.rows
        notes = self._annotations(i - 1) if self.java else self._annotations(i)
        self.add("FUNCTION_DEF", i, span[1], name=span[3], parent=parent, is_method="true" if cls and not parent else None, is_async="true" if "async" in before or self.text(i + 3) == "async" else None, static="true" if "static" in before else None, return_type=self.text(i - 1) if self.java and self.tokens[i - 1][0] == "name" and self.text(i - 1) not in MODIFIERS | {"void", "new"} else None, decorators=notes)
        if at is None or at not in self.match:
            return
        mark = len(kept)
        for pos, (a, b) in enumerate(self.parts(at)):
            raw = self.between(a, b)
            if self.text(a) == "{":
                keys = [k for x, y in self.parts(a) if (k := re.split(r"[:=\s]", self.between(x, y))[0])]
                self.add("PARAMETER", a, b, name=raw, pos=str(pos), group="destructured", keys=keys)
            elif self.text(a) == "...":
                self.add("PARAMETER", a, b, name=self.text(a + 1), pos=str(pos), group="rest")
            elif self.java:
                self.add("PARAMETER", a, b, name=self.text(b), pos=str(pos), group="positional", type=re.sub(r"<.*", "", self.text(b - 1)) if b > a else None)
            else:
                kind = re.match(r"[\w$]+\??\s*:\s*([A-Za-z_$][\w$]*)", raw)
                self.add("PARAMETER", a, b, name=self.text(a), pos=str(pos), group="positional", type=kind[1] if kind else None)
        for row in kept[mark:]:
            row["owner_function"], row["owner_line"] = span[3], span[4]

    def _import(self, i: int) -> None:
        end = self._statement_end(i)
        raw = self.between(i, end)
        if self.java:
            m = re.match(r"import\s+(static\s+)?([\w.]+?)\.(\w+|\*)$", raw)
            if m:
                self.add("IMPORT", i, end, source=m[2], local=m[3], name=m[3], static="true" if m[1] else None, star="star" if m[3] == "*" else None)
            return
        source = re.search(r"""from\s*['"]([^'"]+)['"]""", raw) or re.search(r"""import\s*['"]([^'"]+)['"]""", raw)
        if not source:
            return
        head = raw[len("import") :].split("from")[0]
        if m := re.match(r"\s*(?:type\s+)?([\w$]+)", head):
            self.add("IMPORT", i, end, source=source[1], local=m[1], name="default")
        if m := re.search(r"\*\s*as\s+([\w$]+)", head):
            self.add("IMPORT", i, end, source=source[1], local=m[1], name="*module*")
        if m := re.search(r"\{([^}]*)\}", head):
            for part in filter(None, map(str.strip, m[1].split(","))):
                name, _, alias = part.partition(" as ")
                self.add("IMPORT", i, end, source=source[1], local=(alias or name).strip(), name=name.strip())

    def _reexport(self, i: int) -> None:
        end = self._statement_end(i)
        raw = self.between(i, end)
        source = re.search(r"""from\s*['"]([^'"]+)['"]""", raw)
        if not source:
            return
        if "*" in raw.split("from")[0]:
            self.add("REEXPORT", i, end, source=source[1], exported="*", original="*", star="star")
            return
        for part in filter(None, map(str.strip, re.search(r"\{([^}]*)\}", raw)[1].split(","))):
            name, _, alias = part.partition(" as ")
            self.add("REEXPORT", i, end, source=source[1], exported=(alias or name).strip(), original=name.strip())

    def _variable(self, i: int) -> None:
        end = self._statement_end(i)
        raw = self.between(i, end)
        if m := re.match(r"(?:const|let|var)\s*\{([^}]*)\}\s*=\s*([\s\S]+)", raw):
            req = re.match(r"""require\(\s*['"]([^'"]+)['"]""", m[2])
            for part in filter(None, map(str.strip, m[1].split(","))):
                name, _, alias = part.partition(":")
                if req:
                    self.add("IMPORT", i, end, source=req[1], local=(alias or name).strip(), name=name.strip())
                else:
                    self.add("DESTRUCTURE", i, end, local=(alias or name).strip(), source=m[2], function=name.strip())
            return
        m = re.match(r"(?:const|let|var|[\w$<>,]+)\s+([\w$]+)\s*(?::\s*([\w$]+)[^=]*)?=\s*([\s\S]*)", raw)
        if not m:
            return
        name, kind, value = m[1], m[2], m[3]
        if self.java and not kind:
            kind = re.sub(r"<.*", "", self.text(i))
        if req := re.match(r"""require\(\s*['"]([^'"]+)['"]\s*\)""", value):
            self.add("IMPORT", i, end, source=req[1], local=name, name="*module*")
            return
        made = re.match(r"(?:await\s+)?new\s+(?:[\w$]+\.)*([\w$]+)", value)
        if kind or made:
            self.add("VARIABLE_TYPE", i, end, variable=name, type=kind or made[1])
        if re.fullmatch(r"[\w$]+", value.strip()):
            self.add("ALIAS", i, end, alias=name, original=value.strip())
        self.add("VARIABLE_STATE", i, end, variable=name, value=value)

    def _call(self, i: int, word: str) -> None:
        end = self.match[i + 1]
        j = i
        while self.text(j - 1) == "." and j >= 2:
            j -= 2
            closed = next((k for k, v in self.match.items() if v == j), None) if self.text(j) in CLOSE else None
            if closed is not None:
                j = closed - (self.tokens[closed - 1][0] == "name")
        receiver = self.between(j, i - 2) if j < i else None
        new = self.text(j - 1) == "new"
        call = f"{self.file}:{self.tokens[j][2]}:{self.tokens[end][3]}"
        parts = self.parts(i + 1)
        self.add("CALL", i, end, call_id=call, name=word, receiver=receiver, args=str(len(parts)), new="true" if new else None)
        for pos, (a, b) in enumerate(parts):
            self.add("ARGUMENT", a, b, call_id=call, function=word, pos=str(pos), value=self.between(a, b))
        if receiver in ("router", "app") and word in VERBS and len(parts) >= 2 and self.tokens[parts[0][0]][0] == "string":
            values = [self.between(a, b) for a, b in parts]
            self.add("ROUTE", i, end, method=word.upper(), path=values[0][1:-1], router=receiver, handler=values[-1], middlewares=values[1:-1])
        if receiver and re.fullmatch(r"find\w*|create|save|update\w*|delete\w*|insert\w*|aggregate|query|count\w*", word):
            first = self.between(*parts[0]) if parts else ""
            table = re.search(r"(?i)\b(?:from|into|update)\s+[`\"']?(\w+)", first)
            self.add("DATABASE_OP", i, end, operation=word, model=table[1] if table else receiver.split(".")[-1], query=first if word == "query" else None, connection=receiver)


def extract(file: str, source: str, is_test: bool = False) -> Iterator[dict]:
    reader = _Reader(file, source, is_test)
    return iter(reader.read()) if reader.tokens else iter(())
