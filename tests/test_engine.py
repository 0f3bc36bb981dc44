import json
import os
import threading
import time

import pytest

from quarrydex.functions.vectors import hashing_embedder
from quarrydex.plans import ingest, tools
from quarrydex.schema import Settings
from quarrydex.sources.store import Store


def age(path, seconds):
    t = time.time() - seconds
    os.utime(path, (t, t))


@pytest.fixture
def project(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/__init__.py").write_text("")
    (root / "pkg/alpha.py").write_text('from .beta import helper\nimport json\n\n\ndef alpha_value(x):\n    """Gives alpha."""\n    return helper(x)\n\n\nclass Gamma:\n    def delta(self):\n        return 1\n')
    (root / "pkg/beta.py").write_text("def helper(x):\n    return x\n")
    (root / "notes.log").write_text("plain notes about alpha\n")
    (root / "data.bin").write_bytes(b"\x89PNG\r\n\x00")
    (root / ".gitignore").write_text("*.tmp\n")
    (root / "x.tmp").write_text("never")
    (root / "broken.py").write_text("def broken(:")
    (root / "latin.py").write_bytes(b"# \xe9\n")
    return root, Store(spark, str(tmp_path / "store"))


def counts(result):
    return result.counts["added"], result.counts["updated"], result.counts["deleted"]


def test_scan_life_cycle(project):
    root, store = project
    seen = []
    first = ingest.scan(store, "r", str(root), progress=seen.append)
    assert counts(first) == (7, 0, 0) and len(first.errors) == first.n_errors == 1 and first.errors[0].startswith("latin.py")
    assert [x["phase"] for x in seen][:1] == ["listed"] and [x["phase"] for x in seen][-2:] == ["written", "done"] and seen[-1]["counts"]["added"] == 7
    assert {"phase": "parsed", "files": 8, "of": 8} in seen
    files = {r["path"]: r for r in store.read("files").collect()}
    assert set(files) == {"pkg/__init__.py", "pkg/alpha.py", "pkg/beta.py", "notes.log", "data.bin", ".gitignore", "broken.py"}
    assert files["notes.log"]["package_id"] is None and files["pkg/alpha.py"]["package_id"]
    packages = {r["virtual_path"]: r["id"] for r in store.read("packages").collect()}
    assert set(packages) == {"pkg", "pkg.alpha", "pkg.beta", "broken"}
    edges = {r["to_package_virtual_path"]: r for r in store.read("import_edges").collect()}
    assert edges[".beta"]["to_package_id"] == packages["pkg.beta"] and edges["json"]["external"]
    nodes = {r["name"]: r for r in store.read("nodes").filter("name IS NOT NULL").collect()}
    assert set(nodes) == {"alpha_value", "Gamma", "delta", "helper"} and nodes["delta"]["parent_node_id"] == nodes["Gamma"]["id"]
    assert nodes["helper"]["search_boost"] == 2.0 and nodes["alpha_value"]["fts_needle"].startswith("def alpha value")

    (root / "latin.py").unlink()
    tables = {t: store._manifest(t) for t in ("files", "nodes", "packages", "import_edges")}
    again = ingest.scan(store, "r", str(root))
    assert counts(again) == (0, 0, 0)
    assert tables == {t: store._manifest(t) for t in tables}  # nothing was written again
    ids = {r["id"] for r in store.read("nodes").collect()}
    (root / "pkg/alpha.py").write_text("def alpha_value(x):\n    return 2\n")
    (root / "pkg/beta.py").unlink()
    (root / "broken.py").unlink()
    third = ingest.scan(store, "r", str(root))
    assert counts(third) == (0, 1, 2)
    assert {r["name"] for r in store.read("nodes").collect()} == {"alpha_value"} and store.read("import_edges").count() == 0
    assert {r["virtual_path"] for r in store.read("packages").collect()} == {"pkg", "pkg.alpha"}
    assert ids
    marks = store.read("repos").first()
    assert marks["name"] == "r" and marks["last_scanned"] > 0


def test_scan_of_paths_infers_no_deletes(project):
    root, store = project
    ingest.scan(store, "r", str(root))
    (root / "notes.log").unlink()
    assert counts(ingest.scan(store, "r", str(root), paths=["pkg"])) == (0, 0, 0)
    assert store.read("files").filter("path = 'notes.log'").count() == 1


def test_text_fallback(project):
    root, store = project
    ingest.scan(store, "r", str(root), settings=Settings(parse_unknown_text=True))
    kinds = store.read("nodes").join(store.read("files").select("id", "path").withColumnRenamed("id", "file_id"), "file_id").filter("path IN ('notes.log', 'data.bin')").collect()
    assert [(r["path"], r["kind"]) for r in kinds] == [("notes.log", "literal")]


def test_go_packages(spark, tmp_path):
    root = tmp_path / "go"
    (root / "m").mkdir(parents=True)
    (root / "go.mod").write_text("module example.com\n\ngo 1.20\n")
    (root / "main.go").write_text('package main\n\nimport "example.com/m"\n\nfunc main() {\n\tm.F()\n}\n')
    (root / "m/f.go").write_text("package m\n\nfunc F() {}\n")
    store = Store(spark, str(tmp_path / "store"))
    ingest.scan(store, "g", str(root))
    packages = {r["virtual_path"]: r["id"] for r in store.read("packages").collect()}
    assert set(packages) == {".", "example.com/m"}
    assert [r["to_package_id"] for r in store.read("import_edges").collect()] == [packages["example.com/m"]]


def test_tools(project):
    root, store = project
    engine = tools.Engine(store, {"r": str(root)}, embed=hashing_embedder(64), settings=Settings(refresh_enabled=False))
    hooked = []
    engine.components.append(hooked.append)
    engine.refresh()
    assert hooked and store.read("nodes").filter("embedding_code_vec IS NULL AND body <> ''").count() == 0
    assert json.loads(engine.tool("list_files", {"pattern": "pkg/*.py"})) == ["pkg/__init__.py", "pkg/alpha.py", "pkg/beta.py"]
    assert json.loads(engine.tool("list_files", {"pattern": ".virtual-path/none/*"})) == [] and json.loads(engine.tool("list_files", '{"pattern": "zzz*"}')) == []
    hits = json.loads(engine.tool("search_project", {"query": "helper", "limit": 3}, "json"))
    assert hits[0]["name"] == "helper" and hits[0]["file_path"] == "pkg/beta.py" and hits[0]["body"] == "def helper(x):\n    ..."
    assert {h["kind"] for h in json.loads(engine.tool("search_project", {"query": "alpha gamma", "kind": "class"}, "json"))} == {"class"}
    named = json.loads(engine.tool("search_project", {"summary_mode": "skip", "limit": 4}, "json"))
    assert [h["name"] for h in named if "name" in h][:1] == ["alpha_value"] or named
    with pytest.raises(ValueError):
        engine.tool("search_project", {"visibility": "odd"})
    assert engine.complete_path("alp") == ["pkg/alpha.py"] and engine.complete_path("al") == []
    text = engine.tool("summarize_files", {"paths": ["pkg/alpha.py", "notes.log", "gone"]})
    assert "class Gamma:" in text and "plain notes about alpha" in text and "\n---\n" in text
    with pytest.raises(ValueError):
        engine.tool("summarize_files", {"paths": [], "summary_mode": "source"})
    assert engine.read_files("pkg/beta.py")["body"].startswith("def helper") and engine.read_files("data.bin")["encoding"] == "base64"
    assert engine.read_files("")["status"] == 400 and engine.read_files("nope")["status"] == 404
    with pytest.raises(KeyError):
        engine.tool("nothing")
    assert [s["name"] for s in tools.tool_schemas(Settings(disabled_tools=("read_files",)))] == ["search_project", "list_files", "summarize_files"]


def test_expanded_search_keeps_members(project):
    """Of a class and its method only the method is a hit of its own, and it stays."""
    root, store = project
    with tools.Engine.with_embedder(store, {"r": str(root)}, Settings(refresh_enabled=False, embedding_dim=32, embedding_cache="none")) as engine:
        engine.refresh()
        names = [h.get("name") for h in engine.search_project("Gamma delta", limit=10)]
        assert "delta" in names and "Gamma" not in names
        assert "Gamma" in [h.get("name") for h in engine.search_project("Gamma delta", limit=10, expand=False)]


def test_components_and_debounce(project):
    root, store = project
    calls = []

    class Part(tools.Component):
        def initialize(self, engine):
            calls.append("open")

        def refresh(self, result):
            calls.append(result.counts["added"])

        def destroy(self):
            calls.append("close")

    engine = tools.Engine(store, {"r": str(root)}, settings=Settings(refresh_debounce_s=60), components=[Part()])
    engine.changed("pkg/alpha.py")
    engine.changed("pkg/beta.py", "pkg/alpha.py")
    engine.close()  # what waits is done once
    assert calls == ["open", 2, "close"] and store.read("files").count() == 2
    ran = []
    d = tools.Debounce(ran.append, 0.05)
    for p in "aba":
        d.note(p)
    time.sleep(0.5)
    assert ran == [["a", "b"]]


def test_embedding_queue():
    from quarrydex.streaming.refresh import EmbeddingQueue

    gate, seen = threading.Event(), []

    def run(texts):
        seen.append(texts)
        gate.wait(5)
        if "bad" in texts:
            raise ValueError("bad")
        return {t: [float(len(t))] for t in texts}

    q = EmbeddingQueue(run, batch=3, wait_s=0.01)
    first = q.put("a")
    time.sleep(0.3)  # a batch of its own
    rest = [q.put(t) for t in ("b", "cc", "ddd", "b")]
    urgent = q.put("ddd", urgent=True)
    assert rest[0] is rest[3] and urgent is rest[2]
    gate.set()
    assert first.result(5) == [1.0] and urgent.result(5) == [3.0] and rest[1].result(5) == [2.0]
    with pytest.raises(ValueError):
        q.put("bad").result(5)
    q.close()
    assert seen[0] == ["a"] and seen[1] == ["ddd", "b", "cc"]
    with pytest.raises(RuntimeError):
        q.put("late")


def test_sliced_ranks(spark):
    from quarrydex.operators import search as S

    rows = [(q, i, round((i * 37 % 101) / 7 - 3, 6)) for q in (1, 2) for i in range(200)] + [(1, 900, None)]
    scores = spark.createDataFrame(rows, "query_id int, id int, score double")
    plain, sliced = ({(r["query_id"], r["id"]): r["rank"] for r in S.ranked(scores, -1.0, sliced_ranks=x).collect()} for x in (False, True))
    assert plain == sliced and len(plain) > 200


def test_chunk_settings(project):
    root, store = project
    (root / "long.md").write_text("\n\n".join(f"word{i} " * 10 for i in range(30)))
    ingest.scan(store, "r", str(root), settings=Settings(chunk_max_tokens=20, chunk_min_tokens=5), paths=["long.md"])
    assert store.read("nodes").filter("parent_node_id IS NOT NULL OR kind = 'literal'").count() >= 30


def test_structured_text():
    assert tools.to_structured_text({"b": 1, "a": "x", "c": None, "d": "l1\n```\nl2"}) == "a: x\nb: 1\nd:\n````\nl1\n```\nl2\n````"
    assert tools.to_structured_text(["u", "v"]) == "idx: 0\nvalue: u\n---\nidx: 1\nvalue: v"
    assert tools.to_json({"é": 1, "n": None}) == '{"é": 1}'


def test_refresh_control():
    runs, gate = [], threading.Event()

    def refresh():
        gate.wait(5)
        runs.append(1)

    now = [0.0]
    control = tools.RefreshControl(refresh, 10, lambda: now[0])
    callers = [threading.Thread(target=control.maybe) for _ in range(5)]
    for c in callers:
        c.start()
    gate.set()
    for c in callers:
        c.join()
    assert runs == [1] and not control.maybe()
    now[0] = 11.0
    assert control.maybe() and len(runs) == 2


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarrydex.streaming import refresh as R
    from quarrydex.streaming import windows as W

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.txt").write_text(str(i))
    ran = []
    q = R.refresh_on_change(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda: ran.append(1), per_trigger=2)
    q.awaitTermination(60)
    assert len(ran) == 2
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(os.path.dirname(src) + "/events.parq*")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    q = W.tumbling(timed, "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tumbled").count() == W.tumbling(batch, "1 hour").count()
    requests = spark.createDataFrame([(1, "embed", "a"), (2, "embed", "a"), (3, "drop", "a")], "n int, action string, text string").withColumn("ts", F.timestamp_seconds("n"))
    assert R.pending_requests(requests).count() == 2
    assert R.debounced(requests.withColumn("repo_id", F.lit("r")), "10 seconds").first()["n"] == 3
    assert W.sliding(batch, "1 hour", "30 minutes").count() > W.tumbling(batch, "1 hour").count()
