import textwrap

import pytest

from quarrydex.plans import render
from quarrydex.plans.parsing import languages as L


def parse(key, text, path="a.x", files=()):
    text = textwrap.dedent(text).lstrip("\n")
    nodes, imports = L.parse(key, path, text, frozenset(files))
    return text, nodes, imports


def kinds(nodes):
    return [(n["kind"], n["subtype"], n["name"]) for n in nodes if n["parent_ordinal"] is None]


def summary(key, text, mode="documentation"):
    text, nodes, _ = parse(key, text)
    return render.file_summary(nodes, key, text, mode).strip()


def same(key, text, expected, mode="documentation"):
    assert summary(key, text, mode) == textwrap.dedent(expected).strip("\n").rstrip()


def test_python():
    text = '''
        import os.path as p
        from .near import thing

        # Sums.
        @cache
        def add(a, b=(1, {2: 3})) -> int:
            "Adds."
            return a + b

        class Tree(Base):
            """Grows."""

            HEIGHT = 3

            async def grow(self):
                # not shown
                pass

        if DEBUG:
            run()
        else:
            stop()
    '''
    _, nodes, imports = parse("python", text, "pkg/mod.py", ["pkg/near.py"])
    assert kinds(nodes) == [("literal", None, None), ("literal", None, None), ("comment", None, None), ("function", None, "add"), ("class", None, "Tree"), ("custom", "if", None)]
    assert [(n["kind"], n["name"]) for n in nodes if n["parent_ordinal"] == 4] == [("literal", None), ("method", "grow")]
    assert nodes[3]["header"] == "@cache\ndef add(a, b=(1, {2: 3})) -> int:" and nodes[3]["docstring"] == '"Adds."' and nodes[3]["comment"] == "# Sums."
    assert [(i["virtual_path"], i["physical_path"], i["external"], i["alias"]) for i in imports] == [("os.path", None, True, "p"), (".near", "pkg/near.py", False, None)]
    same("python", text, '''
        import os.path as p
        from .near import thing
        # Sums.
        @cache
        def add(a, b=(1, {2: 3})) -> int:
            "Adds."
            ...
        class Tree(Base):
            """Grows."""
            HEIGHT = 3
            async def grow(self):
                ...
        if DEBUG:
            run()
        else:
            stop()
    ''')
    assert "Adds." not in summary("python", text, "definition") and "# Sums." not in summary("python", text, "definition")


def test_python_try_and_errors():
    _, nodes, _ = parse("python", "try:\n    a()\nexcept E:\n    b()\nfinally:\n    c()\n")
    assert [n["subtype"] for n in nodes if n["kind"] == "block"] == ["try", "except", "finally"]


def test_python_with_errors_keeps_the_rest():
    text, nodes, imports = parse("python", """
        import os
        # makes
        def good(x):
            return x
        def broken(:
            pass
        @deco
        class After:
            def m(self): pass
        S = '''
        not code (
        '''
        if x:
            a()
        else:
            b()
    """)
    names = {n["name"]: n for n in nodes if n["name"]}
    assert set(names) == {"good", "After", "m"} and names["good"]["comment"] == "# makes" and [i["virtual_path"] for i in imports] == ["os"]
    assert all(text.encode()[n["start_byte"] : n["end_byte"]].decode() == n["body"] for n in nodes)
    assert names["After"]["start_line"] == 7 and any("def broken(:" in n["body"] and n["kind"] == "literal" for n in nodes)
    assert [n["subtype"] for n in nodes if n["kind"] == "block"] == ["if", "else"]
    assert kinds(parse("python", "def broken(:")[1]) == [("literal", None, None)] and parse("python", "\x00")[1][0]["kind"] == "literal"


def test_commonjs_exports():
    _, nodes, imports = parse("javascript", """
        const a = require('./a');
        let c;
        c = require("c");
        require('side');
        module.exports = { a, c };
        exports.run = function (x) { return x; };
        exports.N = 3;
        module.exports.K = class K { m() {} };
        config.depth = 4;
    """, "w/m.js", ["w/a.js"])
    assert [(i["virtual_path"], i["physical_path"], i["alias"]) for i in imports] == [("./a", "w/a.js", "a"), ("c", None, "c"), ("side", None, None)]
    tops = [n for n in nodes if n["parent_ordinal"] is None]
    assert [(n["kind"], n["subtype"]) for n in tops[4:8]] == [("custom", "export")] * 4 and all(n["header"] == "export" for n in tops[4:8])
    assert [(n["kind"], n["name"]) for n in nodes if n["parent_ordinal"] in (tops[5]["ordinal"], tops[7]["ordinal"])] == [("function", "exports.run"), ("class", "module.exports.K")]
    assert (tops[2]["kind"], tops[2]["name"], tops[3]["kind"], tops[8]["kind"], tops[8]["name"]) == ("variable", "c", "literal", "variable", "config.depth")


def test_c_function_pointers():
    _, nodes, _ = parse("c", """
        int (*hook)(int, char *);
        void (*chosen)(void) = start;
        char (*grid)[8];
        struct ops { int (*open)(const char *p); long n; };
    """)
    assert kinds(nodes) == [("function", "signature", "hook"), ("variable", None, "chosen"), ("variable", None, "grid"), ("class", "struct", "ops")]
    assert [(n["kind"], n["name"]) for n in nodes if n["parent_ordinal"] is not None] == [("property", "open"), ("property", "n")]


def test_go():
    text = """
        package shop

        import (
        \tlog "example.org/x/log"
        \t"fmt"
        )

        // Item is sold.
        type Item struct {
        \tName string `json:"name"`
        \tfmt.Stringer
        }

        type Seller interface {
        \tSell(i Item) error
        }

        const Max, Min = 3, 1

        func (i *Item) Price(n int) (int, error) {
        \treturn n, nil
        }
    """
    _, nodes, imports = parse("go", text)
    assert kinds(nodes)[2:] == [("comment", None, None), ("class", "struct", "Item"), ("class", "interface", "Seller"), ("const", None, "Max"), ("method", None, "Price")]
    assert [(i["virtual_path"], i["alias"]) for i in imports] == [("example.org/x/log", "log"), ("fmt", None)]
    assert [n["name"] for n in nodes if n["kind"] == "property"] == ["Name", "fmt.Stringer", "Sell"]
    assert summary("go", text).endswith("func (i *Item) Price(n int) (int, error) {\n\t...\n}")
    assert "// Item is sold.\ntype Item struct {\n\tName string `json:\"name\"`" in summary("go", text)


def test_c():
    text = """
        #include <math.h>
        #include "own.h"
        #define TWICE(x) \\
            (2 * (x))
        static int a = 1, *b;
        int f(const char *s, int n);
        // Point.
        struct point { int x; int y[2]; };
        enum e { ONE, TWO = 2 };
        #ifdef X
        int g(void);
        #else
        int h(void);
        #endif
        unsigned long f(const char *s, int n) {
            if (n) { return 1; }
            return 0;
        }
    """
    _, nodes, imports = parse("c", text, "src/m.c", ["src/own.h"])
    assert kinds(nodes) == [
        ("literal", None, None), ("literal", None, None), ("literal", None, "TWICE"), ("variable", None, "a"), ("variable", None, "b"), ("function", "signature", "f"),
        ("comment", None, None), ("class", "struct", "point"), ("class", "enum", "e"), ("custom", "preprocessor", None), ("function", None, "f"),
    ]
    assert [(i["virtual_path"], i["physical_path"], i["external"]) for i in imports] == [("math.h", None, True), ("own.h", "src/own.h", False)]
    assert "#ifdef X\n\t...\n#else\n\t...\n#endif" in summary("c", text)
    assert "enum e {\n\tONE\n\tTWO = 2\n}" in summary("c", text)


def test_cpp():
    text = """
        namespace a::b {
        template <typename T>
        class Stack : public Base<T> {
            int size;
        public:
            Stack();
            ~Stack() {}
            bool operator==(const Stack &o) const;
        };
        int c::d(int x) { return x; }
        }
    """
    _, nodes, _ = parse("cpp", text)
    assert [(n["kind"], n["name"]) for n in nodes[:3]] == [("namespace", "a"), ("namespace", "b"), ("class", "Stack")]
    assert [n["subtype"] for n in nodes if n["kind"] == "block"] == ["private", "public"]
    assert {(n["kind"], n["name"]) for n in nodes if n["kind"] in ("method", "function")} >= {("method", "Stack"), ("method", "~Stack"), ("method", "d")}
    assert nodes[2]["header"].startswith("template <typename T>\nclass Stack")


@pytest.mark.parametrize("key", ["javascript", "typescript"])
def test_scripts(key):
    text = """
        import x, { y } from "./lib/x.js";
        const fs = require('fs');
        export * from "./z.js";
        // adds
        export default function add(a, b) {
          return a / b; // } not the end
        }
        const f = async (a) => { await a; }, n = 1;
        class K extends L {
          m = 1;
          go() { return /[}]/; }
          h = () => { return 2; };
        }
        module.exports = (q) => q;
    """
    _, nodes, imports = parse(key, text, "web/a.js", ["web/lib/x.js"])
    assert [(i["virtual_path"], i["physical_path"], i["external"]) for i in imports] == [("./lib/x.js", "web/lib/x.js", False), ("fs", None, True), ("./z.js", "web/z.js", False)]
    out = summary(key, text)
    for line in ("export default function add(a, b) { ... }", "const f = async (a) => { ... }, n = 1", "  go() { ... }", "  h = () => { ... }", "  m = 1", "module.exports = (q) => { ... }", "// adds"):
        assert line in out.split("\n")
    assert [(n["kind"], n["name"]) for n in nodes if n["kind"] in ("method", "property")] == [("property", "m"), ("method", "go"), ("method", "h")]


def test_typescript_only():
    text = """
        interface Shape<T> extends Base {
          side: number;
          area(n: T): number;
        }
        enum Color { Red = 1, Green }
        abstract class A { abstract name(): string; private x: number = 0; }
        type Pair = { a: number; b: number };
        namespace N { const inner = 1; }
        function id<T>(x: T): { v: T } { return { v: x }; }
    """
    _, nodes, _ = parse("typescript", text)
    assert [k[0] for k in kinds(nodes)] == ["interface", "enum", "class", "literal", "namespace", "function"]
    out = summary("typescript", text)
    assert "enum Color {\n  Red = 1,\n  Green\n}" in out and "function id<T>(x: T): { v: T } { ... }" in out and "  abstract name(): string" in out


def test_terraform():
    text = """
        # one
        # two
        resource "disk" "main" {
          size = 10
          tags = {
            team = "core"
          }
          policy = <<EOF
        { not a block
        EOF
          mount { path = "/x" }
        }
    """
    text, nodes, _ = parse("terraform", text)
    assert kinds(nodes) == [("comment", None, None), ("block", "resource", "disk.main")]
    assert nodes[0]["body"] == "# one\n# two"
    assert [(n["kind"], n["name"]) for n in nodes if n["parent_ordinal"] == 1] == [("property", "size"), ("property", "tags"), ("property", "policy"), ("block", "mount")]
    team = next(n for n in nodes if n["name"] == "team")
    assert render.node_summary(nodes, team["ordinal"], "terraform", parents=True) == 'resource "disk" "main" {\n    ...\n    tags = {\n        ...\n        team = "core"'


def test_markdown_and_text():
    text = "intro\n\n# One\n\nbody\n\n```\n# not a heading\n```\n\n## Two\n\nmore é\n"
    _, nodes, _ = parse("markdown", text)
    assert [(n["kind"], n["name"], n["parent_ordinal"]) for n in nodes] == [("literal", None, None), ("custom", "One", None), ("literal", None, 1), ("literal", "Two", 1)]
    assert nodes[3]["start_line"] == 11 and nodes[3]["end_byte"] == len(text.encode()) - 1
    _, nodes, _ = parse("text", "a\n\nb\n")
    assert [n["kind"] for n in nodes] == ["literal"]


def test_paths_to_nodes_and_modes():
    text, nodes, _ = parse("python", "class A:\n    def f(self):\n        pass\n    def g(self):\n        pass\n")
    g = next(n for n in nodes if n["name"] == "g")
    assert render.node_summary(nodes, g["ordinal"], "python", parents=True) == "class A:\n    ...\n    def g(self):\n        ..."
    assert render.file_summary(nodes, "python", text, "source") == text and render.file_summary(nodes, "python", text, "skip") is None
    with pytest.raises(ValueError):
        render.file_summary(nodes, "python", text, "all")


def test_registry():
    assert L.extension_map({"python": ["pyi"]}, {"md": "text"})[".md"] == "text"
    assert L.extension_map({"python": ["pyi"]})[".pyi"] == "python"
    with pytest.raises(ValueError):
        L.extension_map(override={"md": "none"})
    with pytest.raises(ValueError):
        L.register("python", lambda *a: None, [])
    assert "lambda" in L.KEYWORDS["python"]
