"""What parsers give: a forest of nodes and a list of imports."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Node:
    kind: str
    start: int
    stop: int
    name: str | None = None
    subtype: str | None = None
    header: str | None = None
    docstring: str | None = None
    comment: str | None = None
    body: str | None = None
    children: list[Node] = field(default_factory=list)


@dataclass
class Import:
    """``candidates`` are the paths that the import may mean, best first; one that ends in a slash is a folder.

    Which of them exist, the tree tells.
    """

    raw: str
    virtual_path: str | None = None
    physical_path: str | None = None
    alias: str | None = None
    dot: bool = False
    external: bool = True
    candidates: list[str] = field(default_factory=list)

    def resolve(self, files: frozenset[str]) -> None:
        """An import of a file of the repository is local."""
        found = next((c for c in self.candidates if c in files or c.endswith("/") and any(f.startswith(c) for f in files)), None)
        if found is not None:
            self.physical_path, self.external = found.rstrip("/"), False


class Source:
    """A text with line numbers and byte offsets of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)
        self.plain = text.isascii()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        return at if self.plain else len(self.text[:at].encode())

    def offset(self, line: int, byte_column: int) -> int:
        """Character offset of a one-based line and a byte column, as Python's parser gives them."""
        start = self.starts[line - 1]
        if self.plain:
            return start + byte_column
        end = self.starts[line] if line < len(self.starts) else len(self.text)
        return start + len(self.text[start:end].encode()[:byte_column].decode(errors="ignore"))


def flatten(nodes: list[Node], source: Source) -> list[dict]:
    """Nodes in depth-first order with their ordinal and their parent's."""
    out: list[dict] = []

    def visit(node: Node, parent: int | None) -> None:
        ordinal = len(out)
        last = max(node.start, node.stop - 1)
        out.append({
            "ordinal": ordinal, "parent_ordinal": parent, "kind": node.kind, "subtype": node.subtype, "name": node.name, "header": node.header,
            "docstring": node.docstring, "comment": node.comment, "start_line": source.line(node.start), "end_line": source.line(last),
            "start_byte": source.byte(node.start), "end_byte": source.byte(node.stop), "body": source.text[node.start : node.stop] if node.body is None else node.body,
        })
        for child in node.children:
            visit(child, ordinal)

    for n in nodes:
        visit(n, None)
    return out
