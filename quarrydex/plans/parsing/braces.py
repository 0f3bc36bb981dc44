"""Languages with braces: a scanner that knows strings and comments, and what each language makes of its statements.

Bodies of functions aren't looked into; declarations and their members are.
"""

from __future__ import annotations

import re
from functools import cache

from .model import Import, Node

_CLOSE = {"(": ")", "[": "]", "{": "}"}


class Scanner:
    """Statements of a text between two offsets."""

    line_comments: tuple[str, ...] = ("//",)
    quotes = "\"'"
    raw_quotes = ""

    #: Other characters at which a subclass finds something to skip.
    also_skipped = ""

    def __init_subclass__(cls) -> None:
        cls.skipped = frozenset("/" + cls.quotes + cls.raw_quotes + cls.also_skipped + "".join(c[0] for c in cls.line_comments))
        cls.telling = cls.stops("")

    @classmethod
    @cache
    def stops(cls, chars: str) -> re.Pattern:
        """What a search for ``chars`` has to look at: these, brackets, and where something is skipped."""
        return re.compile("[" + re.escape("".join(sorted(cls.skipped)) + "()[]{}" + chars) + "]")

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.imports: list[Import] = []
        self.closings: dict[int, int] = {}

    # --- lexical level

    def skip(self, i: int) -> int:
        """End of the comment or string that starts at ``i``, or ``i`` itself."""
        t = self.text
        if t[i] not in self.skipped:
            return i
        if any(t.startswith(c, i) for c in self.line_comments):
            end = t.find("\n", i)
            return len(t) if end < 0 else end
        if t.startswith("/*", i):
            end = t.find("*/", i + 2)
            return len(t) if end < 0 else end + 2
        c = t[i]
        if c in self.raw_quotes:
            i += 1
            while i < len(t) and t[i] != c:
                i += 2 if t[i] == "\\" else 1
            return min(len(t), i + 1)
        if c in self.quotes:
            if c == "'" and i and t[i - 1].isalnum() and t[i + 1 : i + 2].isalnum():
                return i + 1  # a digit separator or an apostrophe
            i += 1
            while i < len(t) and t[i] != c and t[i] != "\n":
                i += 2 if t[i] == "\\" else 1
            return min(len(t), i + 1)
        return i

    def is_comment(self, i: int) -> bool:
        return self.text[i] in self.skipped and (self.text.startswith("/*", i) or any(self.text.startswith(c, i) for c in self.line_comments))

    def closing(self, i: int) -> int:
        """Offset of the bracket that closes the one at ``i``; the end of the text if none does.

        Those of the brackets in between are found on the way and kept.
        """
        known = self.closings.get(i)
        if known is not None:
            return known
        t, look, start, open_at = self.text, self.telling.search, i, []
        while m := look(t, i):
            i = m.start()
            j = self.skip(i)
            if j > i:
                i = j
                continue
            if t[i] in "([{":
                open_at.append(i)
            elif t[i] in ")]}":
                if open_at:
                    self.closings[open_at.pop()] = i
                    if not open_at:
                        return i
            i += 1
        self.closings.update(dict.fromkeys(open_at, len(t) - 1))
        return self.closings.get(start, len(t) - 1)

    def find(self, chars: str, i: int, stop: int) -> int:
        """First of ``chars`` at bracket depth zero, or -1."""
        look = self.stops(chars).search
        while m := look(self.text, i, stop):
            i = m.start()
            j = self.skip(i)
            if j > i:
                i = j
                continue
            if self.text[i] in chars:
                return i
            i = self.closing(i) + 1 if self.text[i] in "([{" else i + 1
        return -1

    def line_of(self, i: int) -> int:
        return self.text.count("\n", 0, i)

    # --- statements

    def statement_end(self, i: int, stop: int) -> int:
        raise NotImplementedError

    def items(self, i: int, stop: int):
        """(is comment, start, end) one after another."""
        t = self.text
        while i < stop:
            if t[i].isspace() or t[i] in ";,":
                i += 1
                continue
            if self.is_comment(i):
                j = self.skip(i)
                yield True, i, j
            else:
                j = min(stop, max(i + 1, self.statement_end(i, stop)))
                yield False, i, j
            i = j

    def block(self, i: int, stop: int, inside: str | None = None) -> list[Node]:
        out: list[Node] = []
        run: list[Node] = []
        for comment, a, b in self.items(i, stop):
            if comment:
                if run and self.text[run[-1].stop : a].count("\n") > 1:
                    run = []
                node = Node("comment", a, b)
                trailing = out and out[-1].kind != "comment" and "\n" not in self.text[out[-1].stop : a]
                if not trailing:
                    run.append(node)
                out.append(node)
                continue
            made = self.statement(a, b, inside)
            if run and made and self.text[run[-1].stop : a].count("\n") <= 1:
                self.attach(made[0], "\n".join(self.text[c.start : c.stop] for c in run))
            run = []
            out += made
        return out

    def attach(self, node: Node, comment: str) -> None:
        node.docstring = comment

    def statement(self, a: int, b: int, inside: str | None) -> list[Node]:
        raise NotImplementedError

    def parse(self) -> tuple[list[Node], list[Import]]:
        return self.block(0, len(self.text)), self.imports

    def beside(self, target: str) -> str:
        parts = self.path.split("/")[:-1]
        for p in target.split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p not in ("", "."):
                parts.append(p)
        return "/".join(parts)


class Go(Scanner):
    raw_quotes = "`"

    def statement_end(self, i: int, stop: int) -> int:
        t = self.text
        last = i
        while i < stop:
            j = self.skip(i)
            if j > i:
                last = last if self.is_comment(i) else j - 1
                i = j
                continue
            c = t[i]
            if c == "\n" and t[last] not in ",=+-*/|&.({[<":
                return last + 1
            if c == ";":
                return i
            if not c.isspace():
                last = i
            if c in "([{":
                last = i = min(self.closing(i), stop - 1)
            i += 1
        return last + 1

    def module(self) -> tuple[str, str] | None:
        return None

    def statement(self, a: int, b: int, inside: str | None) -> list[Node]:
        t = self.text[a:b]
        if inside in ("struct", "interface"):
            name = re.match(r"[*\s]*([\w.]+)", t)
            return [Node("property", a, b, name[1] if name else None)]
        word = re.match(r"\w*", t)[0]
        if word == "import":
            for m in re.finditer(r"(?:([\w.]+)\s+)?(\"[^\"]+\"|`[^`]+`)", t):
                target = m[2][1:-1]
                physical = self.beside(target) if target.startswith(".") else None
                folder = [f"{target}/"] if physical is None else []
                alias = m[1] if m[1] != "import" else None
                self.imports.append(Import(m[0], target, physical, alias, alias == ".", physical is None, folder))
            return [Node("literal", a, b)]
        if word == "func":
            m = re.match(r"func\s*(\([^)]*\))?\s*(\w+)", t)
            brace = self.find("{", a, b)
            header = self.text[a : brace + 1] if brace >= 0 else t
            return [Node("method" if m and m[1] else "function", a, b, m[2] if m else None, header=header)]
        if word == "type":
            return self.types(a, b)
        if word in ("var", "const"):
            m = re.match(r"\w+\s+\(?\s*(\w+)", t)
            return [Node("variable" if word == "var" else "const", a, b, m[1] if m else None)]
        return [Node("literal", a, b)]

    def types(self, a: int, b: int) -> list[Node]:
        group = re.match(r"type\s*\(", self.text[a:b])
        if group:
            out = []
            for comment, x, y in self.items(a + group.end(), b - 1):
                out += [] if comment else self.type_spec(x, y, x)
            return out
        return self.type_spec(a, b, a + re.match(r"type\s*", self.text[a:b]).end())

    def type_spec(self, a: int, b: int, name_at: int) -> list[Node]:
        m = re.match(r"(\w+)(\[[^\]]*\])?\s*(struct|interface)\s*\{", self.text[name_at:b])
        name = re.match(r"\w+", self.text[name_at:b])
        if not m:
            return [Node("literal", a, b, name[0] if name else None)]
        brace = name_at + m.end() - 1
        node = Node("class", a, b, m[1], m[3], "type " + self.text[name_at : brace + 1])
        node.children = self.block(brace + 1, self.closing(brace), m[3])
        return [node]


class C(Scanner):
    aggregate = re.compile(r"(?:typedef\s+)?(?:(?:static|const|extern|volatile|inline)\s+)*(struct|union|enum)\b(?:\s+(?:class|struct))?\s*(\w+)?")

    def statement_end(self, i: int, stop: int) -> int:
        t, start = self.text, i
        if t[i] == "#":
            if re.match(r"#\s*if", t[i:]):
                depth = 0
                for m in re.compile(r"^[ \t]*#\s*(if\w*|endif)\b.*(?:\n|$)", re.M).finditer(t, t.rfind("\n", 0, i) + 1, stop):
                    depth += 1 if m[1].startswith("if") else -1
                    if not depth:
                        return m.end() - m[0].endswith("\n")
                return stop
            while i < stop and t[i] != "\n":
                j = self.skip(i)
                i = j if j > i else i + 1 + (t[i] == "\\")
            return i
        access = re.compile(r"(public|private|protected)\s*:(?!:)").match(t, i, stop)
        if access:
            return access.end()
        called = False
        while i < stop:
            j = self.skip(i)
            if j > i:
                i = j
                continue
            c = t[i]
            if c == ";":
                return i + 1
            if c == "#" and not t[t.rfind("\n", 0, i) + 1 : i].strip() and i > start:
                return i
            if c == "{":
                end = self.closing(i)
                head = t[start:i]
                if self.is_type(head, called) or "=" in re.sub(r"operator\s*\W+", "", re.sub(r"\([^()]*\)|<[^<>]*>", "", head)):
                    i = end + 1
                    continue
                return end + 1
            if c in "([":
                called |= c == "("
                i = self.closing(i)
            i += 1
        return stop

    def is_type(self, head: str, called: bool) -> bool:
        return bool(self.aggregate.match(head)) and not called

    def conditional(self, a: int, b: int, inside: str | None) -> list[Node]:
        """``#if`` to ``#endif``: a chain of blocks, one a branch."""
        t = self.text
        marks, depth = [], 0
        for m in re.compile(r"^[ \t]*#\s*(if\w*|el\w+|endif)\b(?:\\\n|[^\n])*", re.M).finditer(t, t.rfind("\n", 0, a) + 1, b):
            depth += m[1].startswith("if")
            if depth == 1:
                marks.append((max(a, m.start()), m.end()))
            depth -= m[1] == "endif"
        out = []
        for (x, y), (z, _) in zip(marks, marks[1:]):
            end = len(t[:z].rstrip()) if t[y:z].strip() else y
            out.append(Node("custom", x, max(y, end), subtype="preprocessor", header=t[x:y].strip(), children=self.block(y, z, inside)))
        if out and len(marks) > 1:
            out[-1].comment = t[marks[-1][0] : marks[-1][1]].strip()
            first = out[0]
            first.children += out[1:]
            if len(out) > 1:
                first.comment = out[-1].comment
                out[-1].comment = None
            first.stop = b
        return out[:1]

    def include(self, t: str) -> None:
        m = re.match(r"#\s*include\s*([<\"])([^>\"]+)", t)
        if m:
            self.imports.append(Import(t, m[2], candidates=[] if m[1] == "<" else [self.beside(m[2]), m[2]]))

    def statement(self, a: int, b: int, inside: str | None) -> list[Node]:
        t = self.text[a:b]
        if t.startswith("#"):
            if re.match(r"#\s*if", t):
                return self.conditional(a, b, inside)
            self.include(t)
            m = re.match(r"#\s*define\s+(\w+)", t)
            return [Node("literal", a, b, m[1] if m else None)]
        if inside == "enum":
            m = re.match(r"\w+", t)
            return [Node("property", a, b, m[0] if m else None)]
        return self.declaration(a, b, a, inside)

    def declaration(self, a: int, b: int, at: int, inside: str | None) -> list[Node]:
        """A declaration whose own text begins at ``at`` (after a template's head)."""
        t, head_at = self.text, at
        brace, paren = self.find("{", at, b), self.find("(", at, b)
        m = self.aggregate.match(t[at:b])
        if m and brace >= 0 and not 0 <= paren < brace:
            kind = m[1]
            tail = re.match(r"\s*(\w+)\s*;", t[self.closing(brace) + 1 : b])
            node = Node("class", a, b, m[2] or (tail[1] if tail else None), kind, self.prefixed(a, head_at, t[at:brace].rstrip() + " {"))
            node.children = self.members(brace, kind)
            return [node]
        if t.startswith(("typedef", "using", "friend"), at):
            m = re.search(r"(\w+)\s*;?$", t[at:b].rstrip("; \n")) if t.startswith("typedef", at) else re.match(r"\w+\s+(\w+)", t[at:b])
            return [Node("literal", a, b, m[1] if m else None)]
        equal = self.find("=", at, b)
        pointer = re.match(r"[\w\s*]+\(\s*[*&]+\s*(?:const\s+)?(\w+)[^()]*\)\s*(\(?)", t[at:b])
        if pointer and brace < 0:
            if inside in ("struct", "union", "class"):
                return [Node("property", a, b, pointer[1])]
            if pointer[2] and equal < 0:
                return [Node("function", a, b, pointer[1], "signature", self.prefixed(a, head_at, t[at:b].rstrip("; \n")))]
            return [Node("variable", a, b - t[:b].endswith(";"), pointer[1])]
        if paren >= 0 and (equal < 0 or paren < equal or re.search(r"operator\s*$", t[at:equal].split("operator")[0] + "operator" if "operator" in t[at:equal] else "")):
            before = t[at:paren]
            name = re.search(r"(operator\s*[^\s\w]+|~?\w+)\s*$", before)
            if name and not re.fullmatch(r"\s*\w+\s*", before) or inside in ("class", "struct") and name:
                method = "::" in before or inside in ("class", "struct")
                kind = "method" if method else "function"
                if brace >= 0 and paren < brace:
                    return [Node(kind, a, b, name[1].strip(), header=self.prefixed(a, head_at, t[at:brace].rstrip() + " {"))]
                return [Node(kind, a, b, name[1].strip(), "signature", self.prefixed(a, head_at, t[at:b].rstrip("; \n")))]
        if not t[at:b].endswith(";") and brace < 0:
            return [Node("literal", a, b)]
        if inside in ("struct", "union", "class"):
            m = re.search(r"(\w+)\s*(?:\[[^\]]*\]|:\s*\d+|=[^;]*|\{[^}]*\})*\s*;?$", t[at:b])
            return [Node("property", a, b, m[1] if m else None)]
        stop = b - 1 if t[b - 1] == ";" else b
        out, part = [], at
        while part < stop:
            comma = self.find(",", part, stop)
            piece = t[part : comma if comma >= 0 else stop]
            m = re.search(r"(\w+)\s*(?:\[[^\]]*\])*\s*$", piece.split("=")[0])
            if m and re.match(r"[A-Za-z_]", m[1]):
                out.append(Node("variable", a, stop, m[1]))
            part = comma + 1 if comma >= 0 else stop
        return out or [Node("literal", a, b)]

    def prefixed(self, a: int, at: int, header: str) -> str:
        return header if a == at else self.text[a:at].rstrip() + "\n" + header

    def members(self, brace: int, kind: str) -> list[Node]:
        return self.block(brace + 1, self.closing(brace), kind)

    def items(self, i: int, stop: int):
        # members of an enum end at commas
        opened = self.text.rfind("{", 0, i) == i - 1 and i > 0
        head = re.search(r"\benum\b[^;{}()]*$", self.text[max(0, i - 200) : i - 1]) if opened else None
        if not head:
            yield from super().items(i, stop)
            return
        t = self.text
        while i < stop:
            if t[i].isspace() or t[i] == ",":
                i += 1
            elif self.is_comment(i):
                j = self.skip(i)
                yield True, i, j
                i = j
            else:
                j = self.find(",", i, stop)
                j = stop if j < 0 else j
                yield False, i, i + len(t[i:j].rstrip())
                i = j


class Cpp(C):
    aggregate = re.compile(r"(?:typedef\s+)?(?:(?:static|const|extern|volatile|inline)\s+)*(struct|union|enum|class)\b(?:\s+(?:class|struct)\b)?\s*(?:\[\[[^\]]*\]\]\s*)?([\w:]+)?")

    def template_end(self, i: int, stop: int) -> int:
        """End of ``template <...>`` heads before a declaration."""
        t = self.text
        while m := re.compile(r"template\s*<").match(t, i, stop):
            depth, j = 1, m.end()
            while j < stop and depth:
                depth += (t[j] == "<") - (t[j] == ">" and t[j - 1] != "-")
                j += 1
            while j < stop and t[j].isspace():
                j += 1
            i = j
        return i

    def is_type(self, head: str, called: bool) -> bool:
        body = re.sub(r"^\s*(template\s*<[^{;]*?>\s*)+(?=class|struct|union|enum|typedef)", "", head)
        return bool(self.aggregate.match(body)) and not called

    def statement(self, a: int, b: int, inside: str | None) -> list[Node]:
        t = self.text
        if t[a] == "#" or inside == "enum":
            return super().statement(a, b, inside)
        m = re.compile(r"(?:inline\s+)?namespace\s*([\w:]*)[^{;]*\{").match(t, a, b)
        if m:
            node = None
            children = self.block(m.end(), self.closing(m.end() - 1))
            for name in reversed(m[1].split("::")):
                node = Node("namespace", a, b, name or None, header=f"namespace {name} {{" if name else "namespace {", children=children)
                children = [node]
            return [node]
        m = re.compile(r'extern\s+"[^"]*"\s*\{').match(t, a, b)
        if m:
            return [Node("custom", a, b, subtype="extern", header=t[a : m.end()], children=self.block(m.end(), self.closing(m.end() - 1)))]
        return self.declaration(a, b, self.template_end(a, b), inside)

    def members(self, brace: int, kind: str) -> list[Node]:
        """Members of classes and structs in sections by access."""
        stop = self.closing(brace)
        if kind not in ("class", "struct"):
            return super().members(brace, kind)
        out: list[Node] = []
        access, begin = ("private" if kind == "class" else None), brace + 1

        def close(end: int) -> None:
            kids = self.block(begin, end, kind)
            if access is None:
                out.extend(kids)
            elif kids:
                out.append(Node("block", kids[0].start, kids[-1].stop, subtype=access, header=f"{access}:", children=kids))

        for comment, a, b in self.items(brace + 1, stop):
            m = None if comment else re.fullmatch(r"(public|private|protected)\s*:", self.text[a:b])
            if m:
                close(a)
                access, begin = m[1], b
        close(stop)
        return out


class JavaScript(Scanner):
    raw_quotes = "`"
    suffixes = tuple(".ts .tsx .js .jsx .mjs".split())
    blocks = re.compile(r"(export\s+)?(default\s+)?(declare\s+)?(async\s+)?(abstract\s+)?(function|class|if|for|while|do|try|switch|interface|enum|namespace|module|with)\b|\{")

    def skip(self, i: int) -> int:
        j = super().skip(i)
        if j == i and self.text[i] == "/":
            before = self.text[:i].rstrip()[-1:] or ";"
            if before in "(,=:[!&|?{};+\n" or re.search(r"\b(return|typeof|case)\s*$", self.text[max(0, i - 12) : i]):
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\n\\])+/\w*").match(self.text, i)
                return m.end() if m else i
        return j

    def statement_end(self, i: int, stop: int) -> int:
        t, start, last = self.text, i, i
        block = bool(self.blocks.match(t, i, stop))
        while i < stop:
            j = self.skip(i)
            if j > i:
                if not self.is_comment(i):
                    last = j - 1
                i = j
                continue
            c = t[i]
            if c == ";":
                return i + 1
            if c == "\n" and i > start and self.ends(t, last, i, stop):
                return last + 1
            typed = c == "{" and t[last] == ":"  # an object type, not a body
            if not c.isspace():
                last = i
            if c in "([{":
                last = i = min(self.closing(i), stop - 1)
                if c == "{" and block and not typed and not re.compile(r"\s*(else|catch|finally|while)\b").match(t, i + 1, stop):
                    return i + 1
            i += 1
        return last + 1

    @staticmethod
    def ends(t: str, last: int, i: int, stop: int) -> bool:
        if t[last] in ",=+-*/%&|^<?:.(" and not t[last - 1 : last + 1] in ("++", "--") or t[last - 1 : last + 1] == "=>":
            return False
        more = re.compile(r"\s*(?://[^\n]*\n\s*|/\*.*?\*/\s*)*", re.S).match(t, i, stop).end()
        return more >= stop or t[more] not in ".,?:+-*/%&|^<>=)]({" or t[more : more + 2] in ("++", "--", "//", "/*")

    def attach(self, node: Node, comment: str) -> None:
        node.comment = comment

    def link(self, raw: str, target: str, alias: str | None = None) -> None:
        local = target.startswith(".") or target.startswith("/")
        base = self.beside(target) if local else None
        tries = [base, *(base + s for s in self.suffixes), *(f"{base}/index{s}" for s in self.suffixes)] if local else []
        self.imports.append(Import(raw, target, base, alias, external=not local, candidates=tries))

    def statement(self, a: int, b: int, inside: str | None) -> list[Node]:
        t = self.text[a:b]
        if inside in ("class", "interface"):
            return [self.member(a, b, inside)]
        if inside == "enum":
            m = re.match(r"[\w\"']+", t)
            return [Node("const", a, b, m[0] if m else None)]
        if re.match(r"import\b", t):
            m = re.search(r"""from\s*["']([^"']+)|^import\s*["']([^"']+)""", t)
            if m:
                alias = re.match(r"import\s+(?:type\s+)?(?:\*\s+as\s+)?(\w+)", t)
                self.link(t, m[1] or m[2], alias[1] if alias and alias[1] != "from" else None)
            return [Node("literal", a, b)]
        m = re.match(r"export\s+(default\s+)?", t)
        if m:
            again = re.search(r"""\bfrom\s*["']([^"']+)""", t) if re.match(r"export\s*(type\s*)?[{*]", t) else None
            if again:
                self.link(t, again[1])
            inner = a + m.end()
            kids = [] if again or self.text[inner] == "{" else self.plain(inner, b)
            useful = [k for k in kids if k.kind != "literal"]
            return [Node("custom", a, b, subtype="export", header=m[0].rstrip(), children=useful or kids)]
        return self.plain(a, b)

    def function_header(self, a: int, b: int) -> tuple[str, int]:
        """Header up to a function's body, and the body's brace or -1."""
        paren = self.find("(", a, b)
        brace = self.find("{", self.closing(paren) + 1 if paren >= 0 else a, b)
        kind = re.compile(r"\s*:\s*\{").match(self.text, self.closing(paren) + 1, b) if paren >= 0 else None
        if kind and brace >= 0:  # the return type is an object type
            more = self.find("{", self.closing(brace) + 1, b)
            brace = more if more >= 0 else brace
        return self.text[a : brace if brace >= 0 else b].rstrip().rstrip(";"), brace

    def plain(self, a: int, b: int) -> list[Node]:
        t = self.text[a:b]
        m = re.match(r"(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*(\w+)?", t)
        if m:
            return [Node("function", a, b, m[1], header=self.function_header(a, b)[0])]
        m = re.match(r"(?:declare\s+)?(?:abstract\s+)?class\b\s*(\w+)?", t)
        if m:
            return [self.class_node(a, b, a, m[1])]
        found = self.typed(a, b, t)
        if found:
            return found
        m = re.match(r"(const|let|var)\b", t)
        if m:
            return [self.lexical(a, b, m[1])]
        m = re.match(r"(module\.exports|exports(?:\.\w+)?|[\w.$\[\]]+)\s*=(?![=>])\s*", t)
        if m:
            value = self.value(a, b, a + m.end(), m[1])
            if re.match(r"(module\.)?exports\b", m[1]):
                return [Node("custom", a, b, subtype="export", header="export", children=[value] if value else [])]
            if value is None:
                self.required(a + m.end(), b, m[1].split(".")[-1])
                return [Node("variable", a, b - t.endswith(";"), m[1])]
            return [value]
        self.required(a, b)
        return [Node("literal", a, b)]

    def required(self, at: int, b: int, alias: str | None = None) -> None:
        """Note the import of a call of ``require``."""
        call = re.compile(r"""\s*(require\(\s*["']([^"']+)["']\s*\))""").match(self.text, at, b)
        if call:
            self.link(call[1], call[2], alias)

    def typed(self, a: int, b: int, t: str) -> list[Node]:
        return []

    def class_node(self, a: int, b: int, at: int, name: str | None) -> Node:
        brace = self.find("{", at, b)
        if brace < 0:
            return Node("literal", a, b, name)
        return Node("class", a, b, name, header=self.text[a:brace].rstrip(), children=self.block(brace + 1, self.closing(brace), "class"))

    def value(self, a: int, b: int, at: int, name: str) -> Node | None:
        """A function or class that is assigned to something, with the text up to its body as header."""
        t = self.text
        if re.compile(r"class\b").match(t, at, b):
            return self.class_node(a, b, at, name)
        m = re.compile(r"(?:async\s*)?(?:function\b\s*\*?\s*\w*\s*)?(?:<[^>(]*>\s*)?").match(t, at, b)
        begin = m.end()
        if t.startswith("(", begin):
            after = self.closing(begin) + 1
        else:
            single = re.compile(r"\w+(?=\s*=>)").match(t, begin, b)
            if not single:
                return None
            after = single.end()
        arrow = re.compile(r"(?:\s*:\s*[^={};]+?)?\s*=>\s*").match(t, after, b)
        if arrow:
            return Node("function", a, b, name, "arrow", header=t[a : arrow.end()].rstrip())
        if "function" in t[at:begin]:
            brace = self.find("{", after, b)
            return Node("function", a, b, name, header=t[a:brace].rstrip())
        return None

    def lexical(self, a: int, b: int, word: str) -> Node:
        t = self.text
        stop = b - 1 if t[b - 1] == ";" else b
        node = Node("custom", a, b, subtype="lexical", header=word)
        part = a + len(word)
        while part < stop:
            while part < stop and t[part].isspace():
                part += 1
            comma = self.find_comma(part, stop)
            end = comma if comma >= 0 else stop
            m = re.compile(r"([\w$]+|[\[{][^=]*?[\]}])").match(t, part, end)
            if m:
                equal = self.find_equal(m.end(), end)
                call = re.compile(r"""\s*require\(\s*["']([^"']+)["']\s*\)""").match(t, equal + 1, end) if equal >= 0 else None
                if call:
                    self.link(t[a:b], call[1], m[0])
                begin = equal + 1 + (len(t[equal + 1 : end]) - len(t[equal + 1 : end].lstrip())) if equal >= 0 else end
                made = self.value(part, end, begin, m[0]) if equal >= 0 else None
                node.children.append(made or Node("const" if word == "const" else "variable", part, part + len(t[part:end].rstrip()), m[0]))
            part = end + 1
        return node

    def find_comma(self, i: int, stop: int) -> int:
        return self.find(",", i, stop)

    def find_equal(self, i: int, stop: int) -> int:
        while (i := self.find("=", i, stop)) >= 0:
            if self.text[i + 1 : i + 2] not in ("=", ">") and self.text[i - 1] not in "=!<>":
                return i
            i += 2
        return -1

    def member(self, a: int, b: int, inside: str) -> Node:
        t = self.text
        stop = b - 1 if t[b - 1] in ";," else b
        m = re.compile(r"(?:(?:public|private|protected|static|readonly|abstract|async|override|get|set|declare)\s+(?=[\w#\[*]))*\*?\s*([#\w$]+|\[[^\]]*\])?\??").match(t, a, stop)
        name = m[1]
        equal, paren = self.find_equal(a, stop), self.find("(", a, stop)
        colon = self.find(":", a, stop)
        if paren >= 0 and (equal < 0 or paren < equal) and (colon < 0 or paren < colon):
            header, brace = self.function_header(a, stop)
            return Node("method", a, stop, name, None if brace >= 0 else "signature", header)
        if equal >= 0:
            begin = equal + 1 + (len(t[equal + 1 : stop]) - len(t[equal + 1 : stop].lstrip()))
            made = self.value(a, stop, begin, name or "")
            if made:
                made.kind = "method" if made.kind == "function" else made.kind
                return made
        return Node("property", a, stop, name)


class TypeScript(JavaScript):
    def typed(self, a: int, b: int, t: str) -> list[Node]:
        m = re.match(r"(?:declare\s+)?(interface|(?:const\s+)?enum|namespace|module|type)\s+([\w$\"'][\w.$\"']*)", t)
        if not m:
            m = re.match(r"declare\s+(?:global\b|module\b)?", t)
            return [Node("custom", a, b, subtype="ambient", header=m[0].strip())] if m else []
        kind = m[1].split()[-1]
        brace = self.find("{", a, b)
        if kind == "type" or brace < 0:
            return [Node("literal", a, b, m[2])]
        kind = {"module": "namespace"}.get(kind, kind)
        inside = kind if kind in ("interface", "enum") else None
        if kind == "enum":
            children = []
            stop = self.closing(brace)
            at = brace + 1
            while at < stop:
                comma = self.find(",", at, stop)
                end = comma if comma >= 0 else stop
                piece = re.sub(r"^(\s|//[^\n]*\n|/\*.*?\*/)+", "", self.text[at:end], flags=re.S)
                if piece.strip():
                    start = end - len(piece)
                    children.append(Node("const", start, start + len(piece.rstrip()), re.match(r"[\w\"']+", piece)[0]))
                at = end + 1
        else:
            children = self.block(brace + 1, self.closing(brace), inside)
        return [Node(kind, a, b, m[2], header=self.text[a:brace].rstrip(), children=children)]


def parser(kind: type[Scanner]):
    def parse(path: str, text: str) -> tuple[list[Node], list[Import]]:
        return kind(path, text).parse()

    return parse
