"""Python sources, with the standard library's own parser; where it finds errors, statement by statement."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from .model import Import, Node, Source

VENV_DIRS = tuple("env venv .env .venv".split())


def _comments(text: str) -> list[tuple[int, int]]:
    """(line, column) of comments that have a line to themselves."""
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT and not t.line[: t.start[1]].strip():
                out.append(t.start)
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return out


def _header_end(text: str, at: int) -> int:
    """Just past the colon at bracket depth zero that ends a compound statement's header."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c in "\"'":
            quote = text[at : at + 3] if text[at : at + 3] in ('"""', "'''") else c
            at += len(quote)
            while at < len(text) and not text.startswith(quote, at):
                at += 2 if text[at] == "\\" else 1
            at += len(quote)
            continue
        if c == "#":
            at = text.find("\n", at)
            if at < 0:
                return len(text)
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and not depth:
            return at + 1
        at += 1
    return len(text)


_BEGIN = re.compile(r"(?m)^(?=[^\s#)\]}])")
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b")
#: Further beginnings of lines that a statement may hold, in strings and brackets, where a text has errors.
_REACH = 8


def _parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _runs(text: str) -> list[tuple[int, int, bool]]:
    """(start, stop, whether it parses) of stretches of top-level statements; one stretch for a text without errors."""
    if _parses(text):
        return [(0, len(text), True)]
    cuts = sorted({0, *(m.start() for m in _BEGIN.finditer(text) if not _GOES_ON.match(text, m.start())), len(text)})
    out: list[tuple[int, int, bool]] = []
    k = 0
    while k + 1 < len(cuts):
        end = next((j for j in range(k + 1, min(len(cuts), k + 1 + _REACH)) if _parses(text[cuts[k] : cuts[j]])), None)
        j = end or k + 1
        if out and out[-1][2] == (end is not None):
            out[-1] = (out[-1][0], cuts[j], out[-1][2])
        else:
            out.append((cuts[k], cuts[j], end is not None))
        k = j
    return [r for r in out if r[2] or text[r[0] : r[1]].strip()]


class _Parser:
    def __init__(self, text: str):
        self.source = Source(text)
        self.text = text
        self.comments = _comments(text)
        self.imports: list[Import] = []

    def span(self, n: ast.AST) -> tuple[int, int]:
        first = min([n, *getattr(n, "decorator_list", [])], key=lambda x: (x.lineno, x.col_offset))
        start = self.source.offset(first.lineno, first.col_offset)
        if first is not n:
            start = self.text.rfind("@", 0, start)
        return start, self.source.offset(n.end_lineno, n.end_col_offset)

    def docstring(self, n: ast.AST) -> str | None:
        if n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
            a, b = self.span(n.body[0])
            return self.text[a:b]
        return None

    def header(self, n: ast.AST) -> str:
        start = self.source.offset(n.lineno, n.col_offset)
        lines = [self.text[slice(*self.span(d))] for d in n.decorator_list]
        return "\n".join([f"@{d}" for d in lines] + [self.text[start : _header_end(self.text, start)]])

    def block(self, body: list[ast.stmt], first: int, last: int, inside: str | None, skip_doc: bool = False) -> list[Node]:
        """Nodes of statements and the comment lines among them, in the order of the text."""
        items: list[Node] = []
        rest = body[1:] if skip_doc else body
        taken = [self.span(s) for s in body]
        for s in rest:
            items.append(self.statement(s, inside))
        column = None if inside is None else (body[0].col_offset if body else None)
        for line, col in self.comments:
            at = self.source.starts[line - 1] + col
            if first <= at < last and not any(a <= at < b for a, b in taken) and (column is None or col == column):
                end = self.text.find("\n", at)
                items.append(Node("comment", at, end if end >= 0 else len(self.text)))
        items.sort(key=lambda n: n.start)
        run: list[Node] = []
        for n in items:
            if n.kind == "comment":
                run.append(n)
                continue
            near = [c for c in run if self.source.line(n.start) - self.source.line(c.start) <= len(run) + 1]
            if near:
                n.comment = "\n".join(self.text[c.start : c.stop] for c in near)
            run = []
        return items

    def statement(self, s: ast.stmt, inside: str | None) -> Node:
        start, stop = self.span(s)
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            return Node("method" if inside == "class" else "function", start, stop, s.name, header=self.header(s), docstring=self.docstring(s))
        if isinstance(s, ast.ClassDef):
            doc = self.docstring(s)
            return Node("class", start, stop, s.name, header=self.header(s), docstring=doc, children=self.block(s.body, start, stop, "class", doc is not None))
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            self.add_import(s, self.text[start:stop])
            return Node("literal", start, stop)
        if isinstance(s, ast.If):
            return Node("custom", start, stop, subtype="if", children=self.branches(s))
        if isinstance(s, (ast.Try, ast.TryStar)):
            parts = [("try", s.body)] + [("except", h.body) for h in s.handlers] + [("else", s.orelse)] * bool(s.orelse) + [("finally", s.finalbody)] * bool(s.finalbody)
            return Node("custom", start, stop, subtype="try", children=[self.branch(name, f"{name}:", body) for name, body in parts])
        return Node("literal", start, stop)

    def branch(self, subtype: str, header: str, body: list[ast.stmt]) -> Node:
        start, stop = self.span(body[0])[0], self.span(body[-1])[1]
        return Node("block", start, stop, subtype=subtype, header=header, children=self.block(body, start, stop, "block"))

    def branches(self, s: ast.If) -> list[Node]:
        out, word = [], "if"
        while True:
            a, b = self.span(s.test)
            out.append(self.branch(word, f"{word} {self.text[a:b]}:", s.body))
            more = s.orelse
            if len(more) == 1 and isinstance(more[0], ast.If) and self.text.startswith("elif", self.source.offset(more[0].lineno, more[0].col_offset)):
                s, word = more[0], "elif"
                continue
            if more:
                out.append(self.branch("else", "else:", more))
            return out

    def add_import(self, s: ast.Import | ast.ImportFrom, raw: str) -> None:
        if isinstance(s, ast.ImportFrom):
            dots = "." * s.level
            path, alias = dots + (s.module or s.names[0].name if s.level else s.module or ""), s.names[0].asname
        else:
            path, alias, dots = s.names[0].name, s.names[0].asname, ""
        self.imports.append(Import(raw, path, alias=alias, dot=bool(dots), external=not dots))


def _candidates(i: Import, path: str) -> list[str]:
    """Modules of the repository that a dotted prefix may name; relative ones count from the file's package."""
    dots = len(i.virtual_path) - len(i.virtual_path.lstrip("."))
    parts = [p for p in i.virtual_path.lstrip(".").split(".") if p]
    base = path.split("/")[:-1]
    base = base[: len(base) - (dots - 1)] if dots > 1 else base if dots else []
    stems = ["/".join([*base, *parts[:n]]) for n in range(len(parts), 0, -1)]
    return [c for s in stems for c in (f"{s}.py", f"{s}/__init__.py") if not any(v in c.split("/") for v in VENV_DIRS)]


def _shift(nodes: list[Node], by: int) -> list[Node]:
    for n in nodes:
        n.start, n.stop = n.start + by, n.stop + by
        _shift(n.children, by)
    return nodes


def parse(path: str, text: str) -> tuple[list[Node], list[Import]]:
    """Nodes and imports.  What can't be parsed becomes literals; the statements around it are read as usual."""
    nodes: list[Node] = []
    imports: list[Import] = []
    for start, stop, ok in _runs(text):
        part = text[start:stop]
        if ok:
            p = _Parser(part)
            nodes += _shift(p.block(ast.parse(part).body, 0, len(part), None), start)
            imports += p.imports
        else:
            nodes.append(Node("literal", stop - len(part.lstrip()), start + len(part.rstrip())))
    for i in imports:
        i.candidates = _candidates(i, path)
    return nodes, imports
