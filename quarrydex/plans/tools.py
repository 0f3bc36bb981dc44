"""The engine's tools: search, listing, summaries, reads; their schemas and output."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.vectors import embedder
from ..operators import files as FL
from ..operators import graph as G
from ..operators import reads as R
from ..operators import search as SE
from ..operators import tree as TR
from ..schema import SUMMARY_MODES, VISIBILITIES, Settings
from ..sources.files import read_tree
from ..sources.store import Store
from ..streaming.refresh import EmbeddingQueue
from . import ingest, render
from .embedding import vectors_of
from .index import TextIndex

# --- output


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def to_json(value) -> str:
    """JSON without nulls, other alphabets kept."""
    return json.dumps(_plain(value), ensure_ascii=False)


def _fence(text: str) -> str:
    inner = [len(m) for m in re.findall(r"(?m)^(`{3,})", text)]
    mark = "`" * max(3, max(inner, default=2) + 1)
    return f"{mark}\n{text}\n{mark}"


def _record(value: dict) -> str:
    lines = []
    for key in sorted(value):
        v = value[key]
        if v is None:
            continue
        if isinstance(v, (dict, list)):
            v = to_json(v)
        elif isinstance(v, bool):
            v = str(v).lower()
        v = str(v)
        lines.append(f"{key}:\n{_fence(v)}" if "\n" in v else f"{key}: {v}")
    return "\n".join(lines)


def to_structured_text(value) -> str:
    """Records of sorted ``key: value`` lines, longer values fenced, records apart by ``---``."""
    if isinstance(value, dict):
        return _record(value)
    if isinstance(value, (list, tuple)):
        records = [v if isinstance(v, dict) else {"idx": i, "value": v} for i, v in enumerate(value)]
        return "\n---\n".join(_record(r) for r in records)
    return str(value)


ENCODERS = {"json": to_json, "structured_text": to_structured_text}

# --- refresh control


class RefreshControl:
    """Runs a refresh at most once per cooldown; callers that come meanwhile share it."""

    def __init__(self, refresh: Callable[[], object], cooldown: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.refresh, self.cooldown, self.clock = refresh, cooldown, clock
        self.last: float | None = None
        self.lock = threading.Lock()
        self.running: threading.Event | None = None

    def maybe(self) -> bool:
        """True if this call ran the refresh."""
        with self.lock:
            if self.running is not None:
                waiting = self.running
            elif self.last is not None and self.clock() - self.last < self.cooldown:
                return False
            else:
                waiting, self.running = None, threading.Event()
        if waiting is not None:
            waiting.wait()
            return False
        try:
            self.refresh()
            self.last = self.clock()
            return True
        finally:
            with self.lock:
                done, self.running = self.running, None
            done.set()


class Debounce:
    """Runs ``action`` with all that was noted, once nothing more has come for ``quiet`` seconds."""

    def __init__(self, action: Callable[[list[str]], object], quiet: float = 1.0):
        self.action, self.quiet = action, quiet
        self.lock, self.noted, self.timer = threading.Lock(), set(), None

    def note(self, *paths: str) -> None:
        with self.lock:
            self.noted |= set(paths)
            if self.timer is not None:
                self.timer.cancel()
            self.timer = threading.Timer(self.quiet, self.run)
            self.timer.daemon = True
            self.timer.start()

    def run(self) -> None:
        """Run now what is waiting."""
        with self.lock:
            paths, self.noted, self.timer = sorted(self.noted), set(), None
        if paths:
            self.action(paths)

    def close(self) -> None:
        with self.lock:
            timer, self.timer = self.timer, None
        if timer is not None:
            timer.cancel()
            self.run()


class Component:
    """A part of a project of one's own; the engine calls it when it opens, after each scan, and when it closes."""

    def initialize(self, engine: Engine) -> None: ...

    def refresh(self, result: ingest.ScanResult) -> None: ...

    def destroy(self) -> None: ...


# --- the engine


class Engine:
    """A project of repositories over a store, and the tools that query it.

    ``embed`` is a column function of texts; with ``Settings.embedder`` set and no
    function given, ``with_embedder`` makes one.
    """

    def __init__(self, store: Store, repos: dict[str, str], *, settings: Settings | None = None, embed=None, embed_model: str | None = None, components: list[Component] | None = None):
        self.store, self.roots, self.settings = store, dict(repos), settings or Settings()
        self.default = next(iter(self.roots))
        self.embed, self.embed_model = embed, embed_model or self.settings.embedder
        self.index = TextIndex(store)
        self.components: list[Component | Callable[[ingest.ScanResult], None]] = list(components or [])
        self.control = RefreshControl(self.refresh, self.settings.refresh_cooldown_s)
        self.debounce = Debounce(self._refresh_paths, self.settings.refresh_debounce_s)
        for c in self.components:
            c.initialize(self)

    @classmethod
    def with_embedder(cls, store: Store, repos: dict[str, str], settings: Settings | None = None, **options) -> Engine:
        s = settings or Settings()
        return cls(store, repos, settings=s, embed=embedder(s.embedder, s.embedding_dim), **options)

    def close(self) -> None:
        """Finish what waits, then let the components go."""
        self.debounce.close()
        for c in self.components:
            if isinstance(c, Component):
                c.destroy()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def refresh(self, paths: list[str] | None = None, progress: Callable[[dict], None] | None = None) -> dict[str, ingest.ScanResult]:
        """Scan every repository, embed what has no vector, and renew the text index if anything changed."""
        out = {}
        for repo, root in self.roots.items():
            out[repo] = ingest.scan(self.store, repo, root, settings=self.settings, paths=paths, progress=progress)
            for c in self.components:
                (c.refresh if isinstance(c, Component) else c)(out[repo])
        if self.embed is not None:
            ingest.embed_missing(self.store, self.embed, self.embed_model, self.settings)
        if not self.index.valid() or any(any(r.counts.values()) for r in out.values()):
            self.index.refresh()
        return out

    def embedding_queue(self) -> EmbeddingQueue:
        """A queue that embeds texts in micro-batches through the cache; it is for the caller to close."""

        def run(texts: list[str]) -> dict[str, list[float]]:
            asked = self.store.spark.createDataFrame([(t,) for t in texts], "text string")
            return {r["text"]: list(r["vector"]) for r in vectors_of(self.store, asked, self.embed, self.embed_model, self.settings).collect()}

        return EmbeddingQueue(run, self.settings.embed_batch, self.settings.embed_wait_s)

    def changed(self, *paths: str) -> None:
        """Note paths that changed on disk; they are scanned together when things are quiet again."""
        self.debounce.note(*paths)

    def _refresh_paths(self, paths: list[str]) -> None:
        self.refresh(paths)

    def tool(self, name: str, params: dict | str | None = None, output: str | None = None) -> str:
        """Run a tool by name with its parameters and encode what it returns."""
        if name not in TOOLS or name in self.settings.disabled_tools:
            raise KeyError(f"no tool {name!r}")
        method, spec, default = TOOLS[name]
        params = json.loads(params) if isinstance(params, str) else dict(params or {})
        known = spec["parameters"]["properties"]
        if extra := set(params) - set(known):
            raise ValueError(f"unknown parameters: {sorted(extra)}")
        if missing := [k for k in spec["parameters"]["required"] if k not in params]:
            raise ValueError(f"missing parameters: {missing}")
        return ENCODERS[output or default](getattr(self, method)(**params))

    # files and nodes with project paths

    def files(self) -> DataFrame:
        f = self.store.read("files").filter(F.col("repo_id").isin(list(self.roots)))
        return f.withColumn("virtual", P.virtual_path(F.col("repo_id"), F.col("path"), self.default, self.settings.project_paths))

    def locate(self, path: str) -> tuple[str, str]:
        """(repository, path) of a project path."""
        if self.settings.project_paths:
            repo, _, rest = path.partition("/")
            return repo, rest
        if path.startswith(P.REPO_PREFIX + "/"):
            repo, _, rest = path[len(P.REPO_PREFIX) + 1 :].partition("/")
            return repo, rest
        return self.default, path

    def list_files(self, pattern: str) -> list[str]:
        repo, glob = self.locate(pattern)
        if repo not in self.roots and (self.settings.project_paths or pattern.startswith(P.REPO_PREFIX)):
            return []
        scoped = [repo] if pattern.startswith(P.REPO_PREFIX) or self.settings.project_paths else list(self.roots)
        found = FL.glob_list(self.files(), glob, repos=scoped, first_repo=self.default, limit=self.settings.list_limit)
        return [r["virtual"] for r in found.select("virtual").collect()]

    def complete_path(self, needle: str, limit: int = 5) -> list[str]:
        asked = self.store.spark.createDataFrame([(0, needle)], "query_id int, needle string")
        found = FL.complete(self.files(), asked, boost_repo=self.default, boost=self.settings.search.repo_boost, limit=limit)
        by_id = {r["id"]: r["virtual"] for r in self.files().join(found.select("id"), "id").select("id", "virtual").collect()}
        return [by_id[r["id"]] for r in found.orderBy("position").collect()]

    def read_files(self, path: str) -> dict:
        repo, inner = self.locate(path or "")
        if not path:
            return {"path": path, "status": 400, "error": "empty path"}
        known = self.files().filter((F.col("repo_id") == repo) & (F.col("path") == inner)).limit(1).count()
        if repo not in self.roots or not known:
            return {"path": path, "status": 404, "error": "not indexed"}
        try:
            row = R.file_envelope(read_tree(self.store.spark, self.roots[repo], [inner])).select("status", "mime", "encoding", "body").first()
        except Exception as e:  # noqa: BLE001
            return {"path": path, "status": 500, "error": str(e)[:200]}
        return {"path": path, **row.asDict()} if row else {"path": path, "status": 404, "error": "missing on disk"}

    def _rows(self, file_ids: DataFrame) -> DataFrame:
        """Node rows with their ordinals, for rendering."""
        n = self.store.read("nodes").join(file_ids, "file_id", "left_semi")
        up = n.select(F.col("id").alias("_up"), F.col("custom_value").cast("int").alias("parent_ordinal"))
        return n.withColumn("ordinal", F.col("custom_value").cast("int")).join(up, F.col("parent_node_id") == F.col("_up"), "left")

    def summarize_files(self, paths: list[str], summary_mode: str = "definition") -> list[dict]:
        if summary_mode not in SUMMARY_MODES or summary_mode == "source":
            raise ValueError(f"summary_mode can't be {summary_mode!r}")
        out = []
        for path in paths:
            repo, inner = self.locate(path)
            f = self.files().filter((F.col("repo_id") == repo) & (F.col("path") == inner)).limit(1)
            row = f.join(self.store.read("packages").select(F.col("id").alias("package_id"), "language"), "package_id", "left").first()
            if row is None:
                continue
            if summary_mode == "skip":
                out.append({"path": path})
                continue
            rows = [r.asDict() for r in self._rows(self.store.spark.createDataFrame([(row["id"],)], "file_id string")).collect()]
            text = None if row["language"] else bytes(read_tree(self.store.spark, self.roots[repo], [inner]).first()["content"]).decode("utf-8", "replace")
            out.append({"path": path, "content": render.file_summary(rows, row["language"], text, summary_mode)})
        return out

    def search_nodes(self, query: str | None, *, limit: int | None = 20, offset: int = 0, kind: str | None = None, visibility: str | None = None, repos: list[str] | None = None) -> DataFrame:
        """Ranked nodes for one needle; text, vectors, both or neither."""
        spark, s = self.store.spark, self.settings.search
        nodes = self.store.read("nodes")
        asked = spark.createDataFrame([(0, query or "")], "query_id int, needle string")
        text = vector = None
        if query:
            text = self.index.scores(asked, self.settings.tokenizer)
            if self.embed is not None:
                q = asked.select("query_id", self.embed(F.col("needle")).alias("vector"))
                vector = SE.cosine_scores(nodes.filter(F.col("embedding_model") == self.embed_model), q, "id", "embedding_code_vec", s.similarity_threshold)
        parts = [F.col("repo_id").isin(repos or list(self.roots))]
        parts += [F.col("kind") == kind] if kind else []
        parts += [F.col("visibility") == visibility] if visibility else []
        where = parts[0]
        for p in parts[1:]:
            where = where & p
        return SE.hybrid_search(nodes, asked, text_scores=text, vector_scores=vector, settings=s, boost_repo=self.default, filters=where, limit=limit, offset=offset)

    def search_project(self, query: str | None = None, kind: str | None = None, visibility: str | None = None, limit: int | None = 10, summary_mode: str = "definition", expand: bool = True) -> list[dict]:
        if visibility is not None and visibility not in VISIBILITIES:
            raise ValueError(f"unknown visibility {visibility!r}")
        if summary_mode not in SUMMARY_MODES:
            raise ValueError(f"unknown summary_mode {summary_mode!r}")
        if self.settings.refresh_enabled:
            self.control.maybe()
        n = limit or 25
        hits = self.search_nodes(query, limit=n, kind=kind, visibility=visibility).withColumnRenamed("parent_node_id", "parent_id")
        if expand:
            nodes = self.store.read("nodes").select("id", F.col("parent_node_id").alias("parent_id"))
            hits = TR.expand_hits(nodes, hits, n)
        hits = G.with_paths(hits, self.store.read("files")).join(self.store.read("packages").select(F.col("id").alias("package_id"), "language"), "package_id", "left")
        found = [r.asDict() for r in hits.orderBy("position").collect()]  # at most ``limit`` rows
        by_file: dict[str, list[dict]] = {}
        if found and summary_mode not in ("skip", "source"):
            ids = self.store.spark.createDataFrame([(f,) for f in {r["file_id"] for r in found}], "file_id string")
            for r in self._rows(ids).collect():
                by_file.setdefault(r["file_id"], []).append(r.asDict())
        out = []
        for r in found:
            item = {"kind": r["kind"], "name": r["name"], "file_path": self.virtual(r["repo_id"], r["file_path"]), "start_line": r["start_line"], "end_line": r["end_line"], "score": r["score"]}
            if summary_mode == "source":
                item["body"] = r["body"]
            elif summary_mode != "skip":
                item["body"] = render.node_summary(by_file.get(r["file_id"], []), int(r["custom_value"]), r["language"] or "text", summary_mode, parents=True)
            out.append(item)
        return out

    def virtual(self, repo: str, path: str | None) -> str | None:
        if path is None:
            return None
        if self.settings.project_paths:
            return f"{repo}/{path}"
        return path if repo == self.default else f"{P.REPO_PREFIX}/{repo}/{path}"


def _kind(kind: str, **more) -> dict:
    return dict(type=kind, **more)


def _tool(name: str, text: str, properties: dict, required: list[str]) -> dict:
    return dict(name=name, description=text, parameters=_kind("object", properties=properties, required=required))


_TEXT = _kind("string")
TOOLS = {
    "search_project": ("search_project", _tool("search_project", "Ranked search over the project's nodes.", {
        "query": _TEXT, "kind": _TEXT, "visibility": _kind("string", enum=list(VISIBILITIES)), "limit": _kind("integer"), "summary_mode": _kind("string", enum=list(SUMMARY_MODES)), "expand": _kind("boolean"),
    }, []), "structured_text"),
    "list_files": ("list_files", _tool("list_files", "Paths that match a glob.", {"pattern": _TEXT}, ["pattern"]), "json"),
    "summarize_files": ("summarize_files", _tool("summarize_files", "Summaries of files.", {"paths": _kind("array", items=_TEXT), "summary_mode": _kind("string", enum=[m for m in SUMMARY_MODES if m != "source"])}, ["paths"]), "structured_text"),
    "read_files": ("read_files", _tool("read_files", "A file's content.", {"path": _TEXT}, ["path"]), "structured_text"),
}


def tool_schemas(settings: Settings | None = None) -> list[dict]:
    """Function-calling schemas of the tools that aren't disabled."""
    off = settings.disabled_tools if settings else ()
    return [spec for name, (_, spec, _) in TOOLS.items() if name not in off]


