"""Plain text and Markdown."""

from __future__ import annotations

import re

from ...operators.chunk import MAX_TOKENS, MIN_TOKENS, chunk_spans
from .model import Import, Node

_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_ITEM = re.compile(r"^ {0,3}([-*+]|\d+[.)])[ \t]+")


Limits = tuple[int, int]
_LIMITS = (MAX_TOKENS, MIN_TOKENS)


def _chunks(text: str, start: int, stop: int, limits: Limits) -> list[Node]:
    return [Node("literal", start + a, start + b) for a, b in chunk_spans(text[start:stop], *limits)]


def parse_text(path: str, text: str, limits: Limits = _LIMITS) -> tuple[list[Node], list[Import]]:
    return _chunks(text, 0, len(text), limits), []


def _trim(text: str, start: int, stop: int) -> int:
    while stop > start and text[stop - 1].isspace():
        stop -= 1
    return stop


def _terminal(text: str, start: int, stop: int, limits: Limits, **fields) -> Node:
    """A section or block without sections below it; long ones get their chunks as children."""
    stop = _trim(text, start, stop)
    parts = _chunks(text, start, stop, limits)
    return Node("literal", start, stop, children=parts if len(parts) > 1 else [], **fields)


def parse_markdown(path: str, text: str, limits: Limits = _LIMITS) -> tuple[list[Node], list[Import]]:
    """Sections by heading level; blocks before the first heading stand alone."""
    heads: list[tuple[int, int, str]] = []  # offset, level, title
    blocks: list[tuple[int, int]] = []
    at, fence, begin = 0, None, None
    for line in text.splitlines(keepends=True):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence = None
        elif mark:
            fence = mark[1]
        elif h := _HEADING.match(line.rstrip("\n")):
            heads.append((at, len(h[1]), h[2]))
        if not heads:
            if line.strip() or fence:
                begin = at if begin is None else begin
            elif begin is not None:
                blocks.append((begin, at))
                begin = None
        at += len(line)
    first = heads[0][0] if heads else len(text)
    if begin is not None:
        blocks.append((begin, first))
    nodes = [_terminal(text, a, b, limits) for a, b in blocks]

    def section(k: int) -> tuple[Node, int]:
        start, level, title = heads[k]
        j = k + 1
        children: list[Node] = []
        own = heads[j][0] if j < len(heads) else len(text)
        while j < len(heads) and heads[j][1] > level:
            child, j = section(j)
            children.append(child)
        stop = heads[j][0] if j < len(heads) else len(text)
        header = text[start : text.find("\n", start) if "\n" in text[start:] else len(text)]
        if not children:
            return _terminal(text, start, stop, limits, name=title, header=header), j
        return Node("custom", start, _trim(text, start, stop), title, "section", header, children=[_terminal(text, start, own, limits), *children]), j

    k = 0
    while k < len(heads):
        node, k = section(k)
        nodes.append(node)
    return nodes, []
