"""Definitions, imports and calls of a Python file, from the standard library's syntax tree.

What counts: calls are recorded inside a definition only; of a definition its body is searched (and its
decorators, as part of what surrounds it), so
default arguments and base classes make no calls; a method is a function that stands directly in a
class; nested functions and classes are named by the file and their own name.
"""

from __future__ import annotations

import ast

from codeloom.functions.names import symbol_name
from codeloom.sources.records import row


def parse(source: bytes) -> ast.Module | None:
    """The tree, or None for a file that does not parse."""
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


class _Walker:
    def __init__(self, path: str, source: bytes) -> None:
        self.path, self.text = path, source.decode("utf-8", "replace")
        self.lines = self.text.splitlines(keepends=True)
        self.rows: list[tuple] = []

    def segment(self, node: ast.AST) -> str:
        return ast.get_source_segment(self.text, node) or ""

    def define(self, node, kind: str, dotted: str, parent: str | None) -> str:
        qn = symbol_name(self.path, dotted)
        marks = [self.segment(d).split("(", 1)[0].strip() for d in node.decorator_list]
        self.rows.append(row(record="definition", path=self.path, qualified_name=qn, name=node.name, kind=kind, start_line=node.lineno, end_line=node.end_lineno, decorators=marks, source=self.segment(node), parent_class=parent))
        return qn

    def walk(self, nodes, scope: str | None, owner: str | None) -> None:
        """owner: the name of the class whose body this is, directly or within its blocks."""
        for node in nodes:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                parent = symbol_name(self.path, owner) if owner else None
                qn = self.define(node, "method" if owner else "function", f"{owner}.{node.name}" if owner else node.name, parent)
                self.walk(self.outside(node), scope, owner)
                self.walk(node.body, qn, None)
            elif isinstance(node, ast.ClassDef):
                qn = self.define(node, "class", node.name, None)
                self.walk(self.outside(node), scope, owner)
                self.walk(node.body, qn, node.name)
            elif isinstance(node, ast.Import):
                for name in node.names:
                    self.add_import(node, name.name)
            elif isinstance(node, ast.ImportFrom):
                self.add_import(node, "." * node.level + (node.module or ""))
            else:
                if isinstance(node, ast.Call) and scope is not None:
                    self.rows.append(row(record="call", path=self.path, qualified_name=scope, callee=self.segment(node.func), line=node.lineno))
                self.walk(ast.iter_child_nodes(node), scope, owner)

    @staticmethod
    def outside(node) -> list[ast.AST]:
        """Decorators stand before the definition, in the surrounding scope."""
        return list(node.decorator_list)

    def add_import(self, node, module: str) -> None:
        self.rows.append(row(record="import", path=self.path, module=module, raw=self.segment(node), line=node.lineno))


def extract(path: str, source: bytes) -> list[tuple]:
    """All rows of the file; a ``broken`` row alone if it does not parse."""
    tree = parse(source)
    if tree is None:
        return [row(record="broken", path=path)]
    walker = _Walker(path, source)
    walker.walk(tree.body, None, None)
    return walker.rows
