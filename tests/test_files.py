import pytest

from quarrydex.functions import paths as P
from quarrydex.sources import files as FS


def test_globs():
    import re

    def match(pattern, path):
        return bool(re.search(P.glob_regex(pattern), path))

    assert match("*.py", "a/b.py") and match("a/*", "a/b/c") and not match("a?c", "abbc")
    assert not match("**/x.py", "x.py") and match("**/x.py", "d/x.py") and not match("a/**/x.py", "a/x.py")
    assert match("[ab]*", "bc") and not match("[!ab]*", "bc") and match("[^a]*", "^") and match("[^a]*", "ab")
    assert match(r"\*x", "*x") and not match(r"\*x", "ax") and not match("A*", "abc")
    assert P.glob_prefix("src/*.py") == "src/"


@pytest.mark.parametrize(
    "rule, path, hit",
    [
        ("*.log", "a/b.log", True), ("/x", "x", True), ("/x", "d/x", False), ("a/b", "a/b", True), ("a/b", "c/a/b", False), ("**/c", "c", True), ("**/c", "a/b/c", True),
        ("d/**", "d/e", True), ("d/**", "d", False), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a?c", "a/c", False), (r"\#x", "#x", True),
    ],
)
def test_ignore_rule(rule, path, hit):
    import re

    assert bool(re.search(FS.compile_ignore(rule)[2], path)) == hit


def test_ignore_rules_nested(spark):
    tree = spark.createDataFrame([(".gitignore", bytearray(b"# top\n*.tmp\nbuild/\n!keep.tmp\n")), ("pkg/.gitignore", bytearray(b"skip.py\n/only.txt\n"))], "path string, content binary")
    names = ["skip.py", "pkg/skip.py", "pkg/sub/deep/skip.py", "pkg/other.py", "a.tmp", "keep.tmp", "build/x.py", "pkg/build/keep.tmp", "build", "pkg/only.txt", "pkg/sub/only.txt"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    left = {r[0] for r in FS.not_ignored(files, FS.ignore_rules(tree)).collect()}
    assert left == {"skip.py", "pkg/other.py", "keep.tmp", "build", "pkg/sub/only.txt"}
    assert FS.compile_ignore("# note") is None and FS.compile_ignore("  ") is None and FS.compile_ignore("!") is None


def test_ignored_dirs_and_parsers(spark):
    files = spark.createDataFrame([(".git/x",), ("a/b.PY",), ("a/.git.py",), ("Makefile",), ("x.tar.md",)], "path string")
    kept = FS.parser_of(FS.ignored_by_dirs(files, [".git"]), {"md": "text"})
    assert {r["path"]: r["parser"] for r in kept.collect()} == {"a/b.PY": "python", "a/.git.py": "python", "Makefile": None, "x.tar.md": "text"}
    assert FS.ignored_by_dirs(files, []).count() == 5


def test_read_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("é")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    rows = {r["path"]: r for r in FS.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"d/a.txt", "b.bin"} and rows["d/a.txt"]["length"] == 2
    assert [r["path"] for r in FS.read_tree(spark, str(tmp_path), ["d", "../etc", "/etc"]).collect()] == ["d/a.txt"]
    newest = max(r["mtime"] for r in rows.values())
    assert FS.read_tree(spark, str(tmp_path), newer_than=newest).count() == 0
    assert FS.read_tree(spark, str(tmp_path), []).count() == 0


def test_remote_files_are_read_one_by_one(spark, tmp_path, monkeypatch):
    from quarrydex.sources import files as FS

    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("x")
    (tmp_path / "a/_y.txt").write_bytes(b"y\xff")
    listed = spark.createDataFrame([("a/x.txt", 1), ("a/_y.txt", 2), ("a/gone.txt", 3)], "path string, n int")
    monkeypatch.setattr(FS, "_local", lambda root: None)
    got = {r["path"]: (bytes(r["content"]), r["n"]) for r in FS.with_content(listed, f"file://{tmp_path}").collect()}
    assert got == {"a/x.txt": (b"x", 1), "a/_y.txt": (b"y\xff", 2)}
