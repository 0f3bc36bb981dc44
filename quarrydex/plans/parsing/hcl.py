"""Terraform (HCL): blocks, attributes, objects, runs of comments."""

from __future__ import annotations

import re

from .braces import Scanner
from .model import Import, Node


class Hcl(Scanner):
    line_comments = ("#", "//")
    quotes = '"'
    also_skipped = "<"

    def skip(self, i: int) -> int:
        m = self.text[i] == "<" and re.compile(r"<<-?(\w+)[^\n]*\n").match(self.text, i)
        if m:
            end = re.compile(rf"^\s*{m[1]}\s*$", re.M).search(self.text, m.end())
            return end.end() if end else len(self.text)
        return super().skip(i)

    def statement_end(self, i: int, stop: int) -> int:
        last = i
        while i < stop:
            j = self.skip(i)
            if j > i:
                last = last if self.is_comment(i) else j - 1
                i = j
                continue
            c = self.text[i]
            if c in "\n," and self.text[last] not in "=?:&|+-*/(":
                return last + 1
            if not c.isspace():
                last = i
            if c in "([{":
                last = i = min(self.closing(i), stop - 1)
            i += 1
        return last + 1

    def block(self, i: int, stop: int, inside: str | None = None) -> list[Node]:
        out: list[Node] = []
        for comment, a, b in self.items(i, stop):
            if not comment:
                out += self.statement(a, b, inside)
            elif out and out[-1].kind == "comment" and self.text[out[-1].stop : a].count("\n") <= 1:
                out[-1].stop = b
            else:
                out.append(Node("comment", a, b))
        return out

    def statement(self, a: int, b: int, inside: str | None) -> list[Node]:
        t = self.text[a:b]
        m = re.match(r'("?[\w.\-]+"?|\([^)]*\))\s*[=:](?!=)\s*', t)
        if m:
            node = Node("property", a, b, m[1].strip('"'), header=t[: m.end()].rstrip())
            at = a + m.end()
            if self.text.startswith("{", at) and not re.match(r"\{\s*for\b", self.text[at:b]):
                node.children = [Node("block", at, self.closing(at) + 1, subtype="object", header="{", children=self.block(at + 1, self.closing(at)))]
            return [node]
        m = re.match(r'([\w\-]+)((?:\s+(?:"[^"]*"|[\w\-]+))*)\s*\{', t)
        if m:
            labels = re.findall(r'"([^"]*)"|([\w\-]+)', m[2])
            brace = a + m.end() - 1
            return [Node("block", a, b, ".".join(x or y for x, y in labels) or m[1], m[1], t[: m.end()], children=self.block(brace + 1, self.closing(brace)))]
        return [Node("literal", a, b)]


def parse(path: str, text: str) -> tuple[list[Node], list[Import]]:
    p = Hcl(path, text)
    nodes, _ = p.parse()
    sources = re.findall(r'(?m)^\s*source\s*=\s*"(\.[^"]*)"', text)
    return nodes, [Import(f'source = "{s}"', s, p.beside(s), external=False) for s in sources]
