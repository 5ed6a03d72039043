"""Definitions, imports and calls of a TypeScript or JavaScript file, from a token scan.

There is no grammar: tokens are cut by one expression (comments, strings, templates, regular
expressions and names), brackets are matched, and definitions are recognised by their heads.
Recognised: function declarations, ``const f = () =>`` and function expressions, ``export default``
functions, classes with their methods, imports, calls and ``new``.  Class fields are not searched.
Unbalanced brackets make a file broken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from codeloom.functions.names import symbol_name
from codeloom.sources.records import row

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
      |(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
      |(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)
      |(?P<number>\d[\w.]*)
      |(?P<mark>=>|\?\.|\.\.\.|[{}()\[\];,.:=<>+\-*/%&|^!~?@\#])
      |(?P<other>.)""",
    re.S | re.X,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Words that a parenthesis may follow without a call.
NO_CALL = {"if", "for", "while", "switch", "catch", "return", "typeof", "function", "await", "void", "delete", "in", "of", "with", "super", "import", "yield", "throw", "case", "do", "else", "instanceof", "new", "async"}
#: Words after which a name in parentheses begins no method.
MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "override", "abstract", "get", "set", "declare"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens_of(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(text):
        if text[at] == "/" and (not out or out[-1].text in "=(,:[!&|?{};+-*%<>~^" or out[-1].text in ("return", "=>", "typeof")) and (m := REGEX.match(text, at)):
            out.append(Token("text", m[0], at, m.end()))
            at = m.end()
            continue
        m = TOKEN.match(text, at)
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out


class _Scan:
    def __init__(self, path: str, text: str) -> None:
        self.path, self.text = path, text
        self.t = tokens_of(text)
        self.close: dict[int, int] = {}
        stack: list[int] = []
        self.broken = False
        for k, tok in enumerate(self.t):
            if tok.kind == "mark" and tok.text in OPEN:
                stack.append(k)
            elif tok.kind == "mark" and tok.text in CLOSE:
                if not stack or OPEN[self.t[stack[-1]].text] != tok.text:
                    self.broken = True
                    return
                self.close[stack.pop()] = k
        self.broken = bool(stack)
        self.rows: list[tuple] = []
        breaks = [m.start() for m in re.finditer("\n", text)]
        self.breaks = breaks

    def line(self, k: int, end: bool = False) -> int:
        from bisect import bisect_left

        return 1 + bisect_left(self.breaks, self.t[k].end - 1 if end else self.t[k].start)

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind != "text" and self.t[k].text in texts

    def name_at(self, k: int) -> str | None:
        return self.t[k].text if 0 <= k < len(self.t) and self.t[k].kind == "name" else None

    def define(self, kind: str, dotted: str, name: str, first: int, last: int, parent: str | None = None) -> str:
        qn = symbol_name(self.path, dotted)
        self.rows.append(row(record="definition", path=self.path, qualified_name=qn, name=name, kind=kind, start_line=self.line(first), end_line=self.line(last, True), decorators=[], source=self.text[self.t[first].start : self.t[last].end], parent_class=parent))
        return qn

    def skip_type(self, k: int) -> int:
        """Past a generic's angle brackets."""
        if not self.is_(k, "<"):
            return k
        depth = 0
        while k < len(self.t):
            depth += self.is_(k, "<")
            depth -= self.is_(k, ">")
            if self.is_(k, "(", "[", "{"):
                k = self.close[k]
            k += 1
            if not depth:
                return k
        return k

    def body_after(self, k: int) -> int | None:
        """The brace that opens a function's body, after its parameters and return type."""
        k = self.skip_type(k)
        if not self.is_(k, "("):
            return None
        k = self.close[k] + 1
        if self.is_(k, ":"):
            k += 1
            while k < len(self.t) and not self.is_(k, "{", ";", "=>"):
                k = self.close[k] + 1 if self.is_(k, "(", "[") else k + 1
            if self.is_(k, "{") and self.is_(self.close[k] + 1, "{"):
                k = self.close[k] + 1  # an object type before the body
        return k if self.is_(k, "{") else None

    def end_of_expression(self, k: int, stop: int) -> int:
        """The last token of the expression at k."""
        while k < stop and not self.is_(k, ";", ","):
            if self.is_(k, "(", "[", "{"):
                k = self.close[k]
            if k + 1 < stop and self.line(k + 1) > self.line(k, True) and self.t[k + 1].kind == "name" and (self.t[k].kind in ("name", "number", "text") or self.is_(k, ")", "]", "}")):
                return k
            k += 1
        return k - 1

    def arrow(self, k: int, stop: int) -> tuple[int, int] | None:
        """First and last token of what the function expression at k does."""
        k += self.is_(k, "async")
        if self.is_(k, "function"):
            k += 1
            k += self.is_(k, "*")
            k += self.name_at(k) is not None
            body = self.body_after(k)
            return (k, self.close[body]) if body is not None else None
        start = k
        k = self.skip_type(k)
        if self.is_(k, "("):
            k = self.close[k] + 1
            if self.is_(k, ":"):
                while k < stop and not self.is_(k, "=>", ";", ","):
                    k = self.close[k] + 1 if self.is_(k, "(", "[", "{") else k + 1
        elif self.name_at(k):
            k += 1
        if not self.is_(k, "=>"):
            return None
        return (start, self.close[k + 1]) if self.is_(k + 1, "{") else (start, self.end_of_expression(k + 1, stop))

    def scan(self, k: int, stop: int, scope: str | None) -> None:
        while k < stop:
            k = self.step(k, stop, scope)

    def step(self, k: int, stop: int, scope: str | None) -> int:
        tok = self.t[k]
        member = self.is_(k - 1, ".", "?.")
        if tok.kind == "name" and not member:
            if tok.text == "import" and not self.is_(k + 1, "(", "."):
                return self.import_(k, stop)
            if tok.text == "export" and self.is_(k + 1, "default"):
                at = k + 2 + self.is_(k + 2, "async")
                found = self.arrow(k + 2, stop)
                if self.is_(at, "function") or found:
                    if found:
                        qn = self.define("function", "default", "default", k, found[1])
                        self.scan(at + 1 if self.is_(at, "function") else found[0], found[1] + 1, qn)
                        return found[1] + 1
                return k + 2
            if tok.text == "function" and (name := self.name_at(k + 1 + self.is_(k + 1, "*"))):
                at = k + 1 + self.is_(k + 1, "*")
                if (body := self.body_after(at + 1)) is not None and not self.is_(k - 1, "=", "(", ",", ":", "return", "=>"):
                    first = k - 1 if self.is_(k - 1, "async") else k
                    qn = self.define("function", name, name, first, self.close[body])
                    self.scan(at + 1, self.close[body] + 1, qn)
                    return self.close[body] + 1
            if tok.text == "class" and (name := self.name_at(k + 1)) and not self.is_(k - 1, "=", "(", ",", ":"):
                return self.class_(k, name, stop)
            if tok.text in ("const", "let", "var") and self.name_at(k + 1) and not self.is_(k - 1, "("):
                return self.variables(k, stop, scope)
        if scope is not None and tok.kind == "name":
            self.call(k, scope, member)
        return k + 1

    def call(self, k: int, scope: str, member: bool) -> None:
        at = self.skip_type(k + 1) if self.is_(k + 1, "<") and re.match(r"<[\w\s,.\[\]|<>]*>\s*\(", self.text[self.t[k + 1].start : self.t[k + 1].start + 200]) else k + 1
        at += self.is_(at, "?.") and self.is_(at + 1, "(")
        name = self.t[k].text
        begun = k
        while self.is_(begun - 1, ".", "?.") and begun >= 2:
            begun -= 2
        new = self.is_(begun - 1, "new")
        if (self.is_(at, "(") and (member or name not in NO_CALL) and not self.is_(k - 1, "function")) or (new and not self.is_(at, ".", "?.")):
            self.rows.append(row(record="call", path=self.path, qualified_name=scope, callee=name, line=self.line(begun - new)))

    def import_(self, k: int, stop: int) -> int:
        at = k + 1
        while at < stop and self.t[at].kind != "text" and not self.is_(at, ";"):
            at = self.close[at] + 1 if self.is_(at, "{") else at + 1
        if at < stop and self.t[at].kind == "text":
            last = at + 1 if self.is_(at + 1, ";") else at
            self.rows.append(row(record="import", path=self.path, module=self.t[at].text[1:-1], raw=self.text[self.t[k].start : self.t[last].end], line=self.line(k)))
            return last + 1
        return at + 1

    def variables(self, k: int, stop: int, scope: str | None) -> int:
        """A declaration: functions among its values get its names, other values are searched."""
        end = k
        at = k + 1
        while at < stop and not self.is_(at, ";", ")", "]", "}"):
            if self.is_(at, "(", "[", "{"):
                at = self.close[at]
            end = at
            if at + 1 < stop and self.line(at + 1) > self.line(at, True) and not self.is_(at, ",", "=", "=>", "?", ":", "+", "-", "*", "&", "|", "(", ".") and not self.is_(at + 1, ".", "?.", ",", "=", "=>", "?", ":", "+", "&", "|", "("):
                break
            at += 1
        last = end + 1 if self.is_(end + 1, ";") else end
        at = k + 1
        while at <= end:
            name = self.name_at(at)
            at += 1
            while at <= end and not self.is_(at, "=", ","):
                at = self.close[at] + 1 if self.is_(at, "(", "[", "{") else at + 1
            if self.is_(at, "="):
                value = at + 1
                if (found := self.arrow(value, end + 1)) and name:
                    self.scan(found[0], found[1] + 1, self.define("function", name, name, k, last))
                    at = found[1] + 1
                else:
                    at = value
                    while at <= end and not self.is_(at, ","):
                        at = self.close[at] + 1 if self.is_(at, "(", "[", "{") else at + 1
                    self.scan(value, at, scope)
            at += 1
        return last + 1

    def class_(self, k: int, name: str, stop: int) -> int:
        at = k + 2
        while at < stop and not self.is_(at, "{"):
            at = self.close[at] + 1 if self.is_(at, "(", "[") else at + 1
        if at >= stop:
            return stop
        first = k - 1 if self.is_(k - 1, "abstract") else k
        owner = self.define("class", name, name, first, self.close[at])
        m, end = at + 1, self.close[at]
        while m < end:
            begun = m
            while self.name_at(m) in MODIFIERS and not self.is_(m + 1, "(", "=", ";", ":", "<"):
                m += 1
            m += self.is_(m, "*")
            m += self.is_(m, "#")
            own = self.name_at(m)
            body = self.body_after(m + 1) if own else None
            if body is not None:
                qn = self.define("method", f"{name}.{own}", own, begun, self.close[body], owner)
                self.scan(m + 1, self.close[body] + 1, qn)
                m = self.close[body] + 1
                continue
            while m < end and not self.is_(m, ";"):
                m = self.close[m] + 1 if self.is_(m, "(", "[", "{") else m + 1
                if m < end and self.line(m) > self.line(m - 1, True):
                    break
            m += self.is_(m, ";")
        return end + 1


def extract(path: str, source: bytes) -> list[tuple]:
    """All rows of the file; a ``broken`` row alone if its brackets do not match."""
    scan = _Scan(path, source.decode("utf-8", "replace"))
    if scan.broken:
        return [row(record="broken", path=path)]
    scan.scan(0, len(scan.t), None)
    return scan.rows
