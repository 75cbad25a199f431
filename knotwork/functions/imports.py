"""Imports of a Python source by its syntax tree."""

from __future__ import annotations

import ast
from dataclasses import dataclass

CALL_SITES, ALL = "call-sites", "all"


@dataclass(frozen=True)
class ExtractOptions:
    """include_local: also what is nested in functions, classes and blocks. string_imports: also strings shaped like
    modules; of ``call-sites`` only or of ``all`` literals. comprehensions: whether the loops of comprehensions are searched."""

    include_local: bool = False
    string_imports: bool = False
    mode: str = CALL_SITES
    min_dots: int = 2
    comprehensions: bool = False


def looks_like_module(value: str, min_dots: int) -> bool:
    """Enough dots, and segments that begin with a letter or _ and go on with letters, digits or _."""
    if value.count(".") < min_dots:
        return False
    return all(s and (s[0] == "_" or s[0].isalpha()) and all(c == "_" or c.isalnum() for c in s) for s in value.split("."))


class _Collector:
    def __init__(self, options: ExtractOptions, line) -> None:
        self.options, self.line, self.depth, self.found = options, line, 0, []

    def _add(self, kind: str, module: str | None, names: list[tuple[str, str | None]], level: int, node: ast.AST) -> None:
        self.found.append((kind, module, names, level, self.line(node)))

    def statement(self, node: ast.stmt) -> None:
        self.depth += 1
        if self.depth == 1 or self.options.include_local:
            if isinstance(node, ast.Import):
                self._add("import", None, [(a.name, a.asname) for a in node.names], 0, node)
            elif isinstance(node, ast.ImportFrom):
                self._add("from", node.module, [(a.name, a.asname) for a in node.names], node.level or 0, node)
        if self.options.include_local or self.depth == 1 and self.options.string_imports:
            self.children(node)
        self.depth -= 1

    def children(self, node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            self.any(child)

    def any(self, node: ast.AST) -> None:
        if isinstance(node, ast.stmt):
            self.statement(node)
        elif isinstance(node, ast.expr):
            self.expression(node)
        elif isinstance(node, ast.arguments):
            positional = [*node.posonlyargs, *node.args]
            defaults = [None] * (len(positional) - len(node.defaults)) + node.defaults
            for default in (*defaults, *node.kw_defaults):
                if default is not None:
                    self.expression(default)
        elif isinstance(node, ast.comprehension) and not self.options.comprehensions:
            return
        else:
            self.children(node)

    def expression(self, node: ast.expr) -> None:
        if not self.options.string_imports:
            return
        if self.depth == 1 or self.options.include_local:
            literal, least = None, 0
            if self.options.mode == ALL:
                literal, least = node, self.options.min_dots
            elif isinstance(node, ast.Call) and node.args:
                callee = node.func
                named = isinstance(callee, ast.Name) and callee.id in ("import_module", "__import__")
                if named or isinstance(callee, ast.Attribute) and callee.attr == "import_module":
                    literal = node.args[0]
            if isinstance(literal, ast.Constant) and isinstance(literal.value, str) and looks_like_module(literal.value, least):
                self._add("string", None, [(literal.value, None)], 0, literal)
        if isinstance(node, ast.JoinedStr):  # its literal pieces are no modules, what it interpolates may hold some
            for value in node.values:
                if isinstance(value, ast.FormattedValue):
                    self.expression(value)
        else:
            self.children(node)


def extract(source: str, options: ExtractOptions = ExtractOptions()) -> list[tuple]:
    """(kind, module, names, level, line) of each import, in order. Raises what the parser raises."""
    tree = ast.parse(source)
    feeds = None
    if "\r" in source:  # only line feeds count as line ends here
        lines = source.replace("\r\n", "\n").split("\n")
        feeds = [i for i, text in enumerate(lines, 1) for _ in range(text.count("\r") + 1)]
    collector = _Collector(options, (lambda n: feeds[n.lineno - 1] if n.lineno <= len(feeds) else n.lineno) if feeds else (lambda n: n.lineno))
    for node in tree.body:
        collector.statement(node)
    return collector.found
