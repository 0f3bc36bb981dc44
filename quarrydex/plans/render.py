"""Summaries of files and nodes in the shape of their language.

A tree is built from node rows (ordinal, parent_ordinal, ...).  Bodies of functions
are cut to ``...``; documentation is shown on request.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Files whose nodes a worker holds at once.
SUMMED_ROWS = 1000
MODES = ("skip", "definition", "documentation", "source")
_INDENT = {"python": "    ", "javascript": "  ", "typescript": "  ", "go": "\t", "c": "\t", "cpp": "\t"}


def tree_of(rows: list[dict]) -> list[dict]:
    """Top-level nodes in the order of their positions, with ``children`` and ``parent``."""
    nodes = {r["ordinal"]: {**r, "children": [], "parent": None} for r in sorted(rows, key=lambda r: (r["start_line"], r["start_byte"], r["ordinal"]))}
    top = []
    for n in nodes.values():
        up = n["parent_ordinal"]
        up = None if up is None or up != up else int(up)
        if up in nodes:
            n["parent"] = nodes[up]
            nodes[up]["children"].append(n)
        else:
            top.append(n)
    return top


def _dedented(text: str, most: int | None = None) -> list[str]:
    """Lines of a text; those after the first lose their common indent."""
    first, *rest = text.split("\n")
    depths = [len(x) - len(x.lstrip()) for x in rest if x.strip()]
    cut = min(depths, default=0)
    cut = cut if most is None else min(cut, most)
    return [first, *(x[cut:] if x.strip() else "" for x in rest)]


def _lines(text: str | None, pad: str, nested: bool = True) -> list[str]:
    if not text:
        return []
    return [pad + x.rstrip() if x.strip() else "" for x in _dedented(text.strip("\n"), None if nested else 0)]


def _flat(text: str | None, pad: str) -> list[str]:
    return [pad + x.strip() for x in (text or "").split("\n") if x.strip()]


class Renderer:
    def __init__(self, language: str, docs: bool = False, comments: bool = False):
        self.step = _INDENT.get(language, "    ")
        self.language, self.docs, self.comments = language, docs, comments

    def node(self, n: dict, pad: str = "", only: set[int] | None = None) -> list[str]:
        """Lines of a node; with ``only``, of the path through these ordinals alone."""
        out = _flat(n["comment"], pad) if self.comments and n["kind"] != "custom" else []
        return out + getattr(self, f"_{n['kind']}", self._body)(n, pad, only)

    def inner(self, n: dict, pad: str, only: set[int] | None) -> list[str]:
        pad += self.step
        kids = [c for c in n["children"] if self.shown(c)]
        if only is not None:
            kids = [c for c in kids if c["ordinal"] in only]
            return [pad + "...", *(x for c in kids for x in self.node(c, pad, only))] if kids else [pad + "..."]
        return [x for c in kids for x in self.node(c, pad)] or [pad + "..."]

    def shown(self, n: dict) -> bool:
        return True

    def _body(self, n: dict, pad: str, only: set[int] | None) -> list[str]:
        return _lines(n["body"], pad, n["parent"] is not None)


class Python(Renderer):
    def _function(self, n, pad, only):
        doc = _lines(n["docstring"], pad + self.step) if self.docs else []
        return _flat(n["header"], pad) + doc + [pad + self.step + "..."]

    _method = _function

    def _class(self, n, pad, only):
        doc = _lines(n["docstring"], pad + self.step) if self.docs else []
        return _flat(n["header"], pad) + doc + self.inner(n, pad, only)

    def _custom(self, n, pad, only):
        kids = n["children"] if only is None else [c for c in n["children"] if c["ordinal"] in only]
        return [x for c in kids for x in self.node(c, pad, only)]

    def _block(self, n, pad, only):
        return _flat(n["header"], pad) + self.inner(n, pad, only)


class Braces(Renderer):
    """Go, C and C++: documentation before the header, a tab a level."""

    def shown(self, n):
        return n["kind"] != "comment"

    def doc(self, n, pad):
        return _lines(n["docstring"], pad) if self.docs else []

    def _comment(self, n, pad, only):
        return [] if self.docs else _lines(n["body"], pad)

    def _function(self, n, pad, only):
        if n["subtype"] == "signature" or not (n["header"] or "").endswith("{"):
            return self.doc(n, pad) + _lines((n["header"] or n["body"]) + (";" if self.language != "go" else ""), pad)
        return self.doc(n, pad) + _lines(n["header"], pad) + [pad + self.step + "...", pad + "}"]

    _method = _function

    def _class(self, n, pad, only):
        return self.doc(n, pad) + _lines(n["header"], pad) + self.inner(n, pad, only) + [pad + "}"]

    _namespace = _class

    def _block(self, n, pad, only):
        return _lines(n["header"], pad) + self.inner(n, pad, only)

    def _custom(self, n, pad, only):
        if n["subtype"] != "preprocessor":
            return self._class(n, pad, only)
        branches = [c for c in n["children"] if c["subtype"] == "preprocessor" and (c["header"] or "").lstrip("# ").startswith("el")]
        own = [c for c in n["children"] if c not in branches]
        out = _flat(n["header"], pad) + ([pad + self.step + "..."] if own else [])
        for c in branches:
            out += self._custom(c, pad, only)
        return out + _flat(n["comment"], pad)

    def _body(self, n, pad, only):
        return self.doc(n, pad) + super()._body(n, pad, only)


class Script(Renderer):
    """JavaScript and TypeScript."""

    def _function(self, n, pad, only):
        if n["subtype"] == "signature":
            return _lines(n["header"], pad)
        lines = _lines(n["header"], pad)
        lines[-1] += " { ... }"
        return lines

    _method = _function

    def _class(self, n, pad, only):
        lines = _lines(n["header"], pad)
        lines[-1] += " {"
        return lines + self.inner(n, pad, only) + [pad + "}"]

    _interface = _class

    def _enum(self, n, pad, only):
        kids = [c["body"] for c in n["children"]]
        return [f"{pad}{n['header']} {{", *(f"{pad}{self.step}{b}{',' * (i + 1 < len(kids))}" for i, b in enumerate(kids)), pad + "}"]

    def _custom(self, n, pad, only):
        kids = n["children"]
        if n["subtype"] == "lexical":
            parts = [self.node(c, pad, only) for c in kids]
            if not parts:
                return self._body(n, pad, only)
            out = parts[0]
            for p in parts[1:]:
                out = [*out[:-1], f"{out[-1]}, {p[0].strip()}", *p[1:]]
            return [f"{pad}{n['header']} {out[0].strip()}", *out[1:]]
        if n["subtype"] == "export" and kids and kids[0]["kind"] != "literal":
            first, *rest = self.node(kids[0], pad, only)
            word = "" if first.strip().startswith(("module.exports", "exports")) else f"{n['header']} "
            return [f"{pad}{word}{first.strip()}", *rest]
        return self._body(n, pad, only)


class Terraform(Renderer):
    def _property(self, n, pad, only):
        return self.path(n, pad, only) if only is not None and n["children"] else self._body(n, pad, None)

    def _block(self, n, pad, only):
        return self.path(n, pad, only) if only is not None else self._body(n, pad, None)

    def path(self, n, pad, only):
        kids = [c for c in n["children"] if c["ordinal"] in only]
        if not kids:
            return self._body(n, pad, None)
        if n["subtype"] == "object":  # an object's braces belong to its attribute
            return [x for c in kids for x in self.node(c, pad, only)]
        return [pad + n["body"].split("\n")[0].strip(), pad + self.step + "...", *(x for c in kids for x in self.node(c, pad + self.step, only))]


RENDERERS: dict[str, type[Renderer]] = {"python": Python, "go": Braces, "c": Braces, "cpp": Braces, "javascript": Script, "typescript": Script, "terraform": Terraform}


def renderer(language: str, docs: bool = False, comments: bool = False) -> Renderer:
    return RENDERERS.get(language, Renderer)(language, docs, comments)


def file_summary(rows: list[dict], language: str | None, text: str | None, mode: str) -> str | None:
    """A file's summary; without a language, or for the mode ``source``, its text."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "skip":
        return None
    if mode == "source" or not language:
        return text
    docs = mode == "documentation"
    r = renderer(language, docs)
    return "\n".join(x for n in tree_of(rows) if docs or n["kind"] != "comment" for x in r.node(n))


def node_summary(rows: list[dict], ordinal: int, language: str, mode: str = "definition", parents: bool = False) -> str:
    """A node's summary, or with ``parents`` the path from its file's top down to it."""
    stack = tree_of(rows)
    found = None
    while stack:
        n = stack.pop()
        if n["ordinal"] == ordinal:
            found = n
            break
        stack += n["children"]
    if found is None:
        return ""
    if mode == "source":
        return found["body"]
    r = renderer(language, mode == "documentation")
    if not parents:
        return "\n".join(r.node({**found, "parent": found["parent"]}))
    path, n = set(), found
    while n is not None:
        path.add(n["ordinal"])
        top, n = n, n["parent"]
    below = [found]
    while below:
        x = below.pop()
        path.add(x["ordinal"])
        below += x["children"]
    return "\n".join(r.node(top, "", None if top is found else path))


def summaries(nodes: DataFrame, files: DataFrame, mode: str) -> DataFrame:
    """(file_id, summary) of every file: its nodes, which one file bounds, meet it in one row."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    columns = ["ordinal", "parent_ordinal", "kind", "subtype", "name", "header", "docstring", "comment", "start_line", "start_byte", "body"]
    trees = nodes.groupBy(F.col("file_id").alias("_f")).agg(F.collect_list(F.struct(*columns)).alias("nodes"))
    rows = files.select("file_id", "language", "text").join(trees, F.col("file_id") == F.col("_f"), "left").drop("_f")

    kind = to_arrow_type(files.schema["file_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SUMMED_ROWS):
                some = batch.slice(at, SUMMED_ROWS)
                files = zip(*(some.column(c).to_pylist() for c in ("nodes", "language", "text")))
                out = [file_summary(n or [], lang, text, mode) for n, lang, text in files]
                yield pa.RecordBatch.from_arrays([some.column("file_id").cast(kind), pa.array(out, pa.string())], names=["file_id", "summary"])

    return rows.mapInArrow(run, f"file_id {files.schema['file_id'].dataType.simpleString()}, summary string")


def node_lines(nodes: Iterator[dict]) -> Iterator[str]:
    """Plain text of nodes, one after another."""
    for n in nodes:
        yield from (n["body"] or "").split("\n")
