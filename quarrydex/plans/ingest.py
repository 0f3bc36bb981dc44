"""Incremental ingest of a repository into the store.

List, look up, parse what changed, merge, drop what vanished, resolve imports: each
step is one set-based plan over all files.  Ids are hashes of what they stand for,
so a second run over the same files gives the same rows.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import paths as P
from ..functions import text as X
from ..operators import graph as G
from ..operators import search as SE
from ..operators import snapshots as SN
from ..operators.statistics import action_counts
from ..schema import Settings
from ..sources import files as FS
from ..sources.store import Store
from .parsing.languages import PACKAGED, parse

_NODE = (
    "struct<ordinal:int,parent_ordinal:int,kind:string,subtype:string,name:string,header:string,docstring:string,comment:string,"
    "start_line:int,end_line:int,start_byte:int,end_byte:int,body:string>"
)
_IMPORT = "struct<raw:string,virtual_path:string,physical_path:string,alias:string,dot:boolean,external:boolean,candidates:array<string>>"
#: Errors that a result lists; ``n_errors`` counts them all.
LISTED_ERRORS = 100
#: Files whose nodes a worker holds at once.
PARSED_ROWS = 1000
#: Files after which a scan tells again how far it is.
PROGRESS_FILES = 100


@dataclass
class ScanResult:
    counts: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    n_errors: int = 0
    seconds: float = 0.0


def parse_files(files: DataFrame, chunks: tuple[int, int] | None = None) -> DataFrame:
    """``files`` (path, content, parser) with status, error, nodes and imports.

    A failure is that file's row: it never ends the scan.  Imports come with their
    candidates, see ``resolve_candidates``.  ``chunks`` bounds the tokens of a chunk of prose.
    """

    schema = f"path string, mtime bigint, hash string, parser string, status string, error string, nodes array<{_NODE}>, imports array<{_IMPORT}>"
    made = [pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARSED_ROWS):
                some = batch.slice(at, PARSED_ROWS)
                out = []
                for path, content, key in zip(*(some.column(c).to_pylist() for c in ("path", "content", "parser"))):
                    if key is None:
                        out.append(("bare_file", None, [], []))
                        continue
                    try:
                        nodes, imports = parse(key, path, bytes(content).decode("utf-8"), None, chunks)
                        out.append(("parsed_file", None, nodes, imports))
                    except Exception as e:  # noqa: BLE001
                        out.append(("error", f"{type(e).__name__}: {e}"[:500], [], []))
                kept = [some.column(f.name) for f in made[:4]]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(x, f.type) for x, f in zip(zip(*out), made[4:])], schema=pa.schema(made))

    read = files.select("path", F.col("mtime").cast("long").alias("mtime"), "hash", "parser", "content")
    return read.mapInArrow(run, schema)


def node_needle(s: Settings, path: str = "path"):
    """What the text index sees of a node; ``path`` is the column of its file's path."""
    fields = {k: F.col(k) for k in ("name", "header", "body", "docstring")}
    return X.search_needle(fields | {"file_path": F.col(path)}, s.search.field_boosts, s.tokenizer)


def with_needles(nodes: DataFrame, files: DataFrame, s: Settings) -> DataFrame:
    """``nodes`` with the needles that their fields and their files' paths give now."""
    paths = files.select(F.col("id").alias("_f"), F.col("path").alias("_path"))
    joined = nodes.join(paths, F.col("file_id") == F.col("_f"), "left")
    return joined.withColumn("fts_needle", node_needle(s, "_path")).select(*nodes.columns)


def resolve_candidates(imports: DataFrame, names: DataFrame) -> DataFrame:
    """``imports`` (path, i, e) with ``physical_path`` and ``external``: the first candidate that the tree has, if any.

    ``names`` are the tree's paths; candidates meet them in a join, and are no longer in ``e``.
    """
    up = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(up) - 1), lambda n: F.concat(F.array_join(F.slice(up, 1, n), "/"), F.lit("/")))
    there = names.select("path").unionAll(names.filter(F.instr("path", "/") > 0).select(F.explode(folders))).distinct().select(F.col("path").alias("candidate"))
    # the imports are read once: a candidate's row carries its import along, and meets the others again by a row number
    row = F.struct(*[F.col("e").dropFields("candidates").alias("e") if c == "e" else c for c in imports.columns])
    numbered = imports.select(F.monotonically_increasing_id().alias("_row"), row.alias("_import"), F.col("e.candidates").alias("_c"))
    numbered = numbered.select("_row", "_import", F.posexplode_outer("_c").alias("_k", "_candidate"))
    met = numbered.join(there.select(F.col("candidate").alias("_candidate"), F.lit(True).alias("_there")), "_candidate", "left")
    best = F.min_by("_candidate", F.when(F.col("_there"), F.col("_k")))
    out = met.groupBy("_row", "_import.path", "_import.i").agg(F.first("_import").alias("_import"), F.regexp_replace(best, "/$", "").alias("_found"))
    out = out.select("_import.*", "_found")
    return out.withColumn("physical_path", F.coalesce("_found", "e.physical_path")).withColumn("external", F.col("e.external") & F.col("_found").isNull()).drop("_found")


def _id(*parts):
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def go_modules(tree: DataFrame) -> DataFrame:
    """(prefix, module) of the folders with a module file."""
    mod = tree.filter(F.col("path").rlike(r"(^|/)go\.mod$"))
    return mod.select(F.regexp_replace("path", r"/?go\.mod$", "").alias("prefix"), F.regexp_extract(F.col("content").cast("string"), r"(?m)^module\s+(\S+)", 1).alias("module"))


def scan(store: Store, repo_id: str, root: str, *, settings: Settings | None = None, paths: list[str] | None = None, progress: Callable[[dict], None] | None = None) -> ScanResult:
    """Bring the store up to date with the files of a repository.

    Only the repository's own rows are read and written again, and nothing is written
    where nothing changed.  ``progress`` is called with the phase and what it counted:
    listed, every ``PROGRESS_FILES`` parsed files at the most, written, done.
    """
    s, spark, began = settings or Settings(), store.spark, time.time()
    tell = progress or (lambda _: None)
    start_ns = int(began * 1e9)
    repos = store.read("repos", repo_id)
    mark = repos.select("last_scanned").first()
    mark = mark[0] if mark else None

    tree = store.work(FS.list_tree(spark, root, paths, skip_dirs=tuple(s.ignored_dirs)))
    ruled = tree if paths is None else FS.list_tree(spark, root, skip_dirs=tuple(s.ignored_dirs))
    rules = FS.ignore_rules(FS.with_content(ruled.filter(F.col("path").rlike(r"(^|/)\.gitignore$")), root))
    names = store.work(FS.not_ignored(tree, rules))
    tell({"phase": "listed", "files": names.count()})
    stored = store.read("files", repo_id)
    fresh = FS.with_content(names if mark is None else names.filter(F.col("mtime") > mark), root)
    fresh = fresh.withColumn("hash", SN.content_hash("content"))
    todo = SN.changes(fresh, stored, mark).filter("action IN ('insert', 'update')")
    todo = FS.parser_of(todo, s.parser_extensions, s.language_extensions)
    if s.parse_unknown_text:
        todo = todo.withColumn("parser", F.coalesce("parser", F.when(X.is_text(F.col("content")), "text")))
    # what was parsed is a table, so that files which change meanwhile, or a lost executor, make no mixed results
    todo = store.work(todo)
    total = todo.count()
    parsed = _parsed(store, todo, (s.chunk_max_tokens, s.chunk_min_tokens), total, tell)

    done = parsed.filter("status <> 'error'")
    with_packages = done.filter(F.col("parser").isin(*PACKAGED) & (F.col("status") == "parsed_file"))
    virtual = P.module_path(F.col("path"), F.col("parser"))
    modules = go_modules(FS.with_content(names.filter(F.col("path").rlike(r"(^|/)go\.mod$")), root))
    if not modules.isEmpty():
        folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
        placed = G.longest_prefix(with_packages.filter("parser = 'go'").select("path", folder.alias("folder")).distinct(), modules, "folder").join(modules, "prefix", "left")
        rest = F.expr("trim(LEADING '/' FROM substring(folder, length(prefix) + 1))")
        main = with_packages.filter("parser = 'go'").select("path", F.exists("nodes", lambda n: n["body"].rlike(r"^package\s+main\b")).alias("_main"))
        named = placed.join(main, "path").select("path", F.when(F.col("_main") | F.col("module").isNull(), F.when(F.col("folder") == "", ".").otherwise(F.col("folder"))).otherwise(F.concat_ws("/", "module", F.when(rest != "", rest))).alias("_v"))
        with_packages = with_packages.join(named, "path", "left")
        virtual = F.coalesce("_v", virtual)
    with_packages = with_packages.withColumn("virtual_path", virtual)
    physical = F.when(F.col("parser") == "go", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")).otherwise(F.col("path"))
    with_packages = with_packages.withColumn("physical_path", physical).withColumn("package_id", _id(F.lit(repo_id), F.col("virtual_path")))

    packages = with_packages.select(
        F.col("package_id").alias("id"), P.package_name(F.col("virtual_path")).alias("name"), F.lit(repo_id).alias("repo_id"), F.col("parser").alias("language"), "virtual_path", "physical_path"
    ).dropDuplicates(["id"])
    file_id = _id(F.lit(repo_id), F.lit("file"), F.col("path"))
    owners = with_packages.select("path", "package_id")
    new_files = done.join(owners, "path", "left").select(file_id.alias("id"), F.lit(repo_id).alias("repo_id"), "package_id", "path", F.col("hash").alias("file_hash"), F.col("mtime").alias("last_updated"))
    flat = done.join(owners, "path", "left").select("path", "parser", "package_id", file_id.alias("file_id"), F.explode("nodes").alias("n")).select("path", "parser", "package_id", "file_id", "n.*")
    node_id = lambda c: _id(F.lit(repo_id), F.col("path"), F.col(c).cast("string"))
    visibility = F.when(F.col("subtype").isin("public", "private", "protected"), F.col("subtype"))
    nodes = flat.select(
        node_id("ordinal").alias("id"), F.lit(repo_id).alias("repo_id"), "file_id", "package_id", F.when(F.col("parent_ordinal").isNotNull(), node_id("parent_ordinal")).alias("parent_node_id"),
        "name", "body", "header", "kind", "subtype", "docstring", "comment", F.col("ordinal").cast("string").alias("custom_value"), "start_line", "end_line", "start_byte", "end_byte",
        SE.kind_boost(F.col("kind"), s.search.kind_boosts).cast("float").alias("search_boost"), visibility.alias("visibility"),
        node_needle(s).alias("fts_needle"),
    )
    old_nodes = store.read("nodes", repo_id)
    vectors = old_nodes.filter("embedding_code_vec IS NOT NULL").select("file_id", X.embedding_text(F.col("docstring"), F.col("body")).alias("text"), F.struct("embedding_code_vec", "embedding_model").alias("vector"), F.col("id").alias("ordinal"))
    nodes = SN.reuse_embeddings(nodes.withColumn("text", X.embedding_text(F.col("docstring"), F.col("body"))), vectors)
    nodes = nodes.withColumn("embedding_code_vec", F.col("vector.embedding_code_vec")).withColumn("embedding_model", F.col("vector.embedding_model")).drop("vector", "text")

    edges = done.join(owners, "path", "left").select("path", F.col("package_id").alias("from_package_id"), file_id.alias("from_file_id"), F.posexplode("imports").alias("i", "e"))
    all_names = names if paths is None else FS.not_ignored(ruled, rules)
    edges = resolve_candidates(edges, all_names)
    edges = edges.select(
        _id(F.lit(repo_id), F.col("path"), F.lit("import"), F.col("e.virtual_path"), F.coalesce("e.alias", F.lit("\x00")), F.col("e.dot").cast("string")).alias("id"), F.lit(repo_id).alias("repo_id"), "from_package_id", "from_file_id",
        F.col("physical_path").alias("to_package_physical_path"), F.col("e.virtual_path").alias("to_package_virtual_path"), F.col("e.alias").alias("alias"), F.col("e.dot").alias("dot"), "external", F.col("e.raw").alias("raw"),
    ).dropDuplicates(["id"])

    changed = store.work(new_files.select("id"))
    gone = store.work(SN.vanished(stored, names).select("id")) if paths is None else stored.select("id").filter(F.lit(False))
    counts = {r["action"]: r["n"] for r in action_counts(done).collect()}
    failed = parsed.filter("status = 'error'")
    result = ScanResult({"added": counts.get("insert", 0), "updated": counts.get("update", 0), "deleted": gone.count()}, n_errors=failed.count())
    result.errors = [f"{r['path']}: {r['error']}" for r in failed.select("path", "error").orderBy("path").limit(LISTED_ERRORS).collect()]

    if any(result.counts.values()):
        replaced = changed.unionAll(gone)
        mine = [repo_id]
        files_now = SN.delete(stored, replaced).unionByName(new_files, allowMissingColumns=True)
        nodes_now = SN.delete(old_nodes, replaced, "file_id").unionByName(nodes, allowMissingColumns=True)
        old_edges = store.read("import_edges", repo_id)
        all_edges = SN.delete(old_edges, replaced, "from_file_id").unionByName(edges, allowMissingColumns=True)
        all_packages = SN.upsert(store.read("packages", repo_id), packages, ["id"])
        used = all_packages.join(files_now.select(F.col("package_id").alias("_p")), F.col("id") == F.col("_p"), "left_semi")
        packages_now = store.work(used)
        # a Go import names a package by its module path, which only the packages tell
        inside = packages_now.filter("language = 'go'").select(F.col("repo_id").alias("_r"), F.col("virtual_path").alias("_v"), F.lit(True).alias("_in"))
        edges_now = all_edges.drop("to_package_id").join(inside, (F.col("repo_id") == F.col("_r")) & (F.col("to_package_virtual_path") == F.col("_v")), "left")
        edges_now = edges_now.withColumn("external", F.col("external") & F.col("_in").isNull()).drop("_r", "_v", "_in")
        resolved = store.work(G.resolve_imports(edges_now, packages_now))
        edge_columns = ["id", "to_package_id", "external"]
        differ = not G.diff(old_edges.select(*edge_columns), resolved.select(*edge_columns), edge_columns).filter("action <> 'update'").isEmpty()
        store.write("files", files_now, mine)
        store.write("nodes", nodes_now, mine)
        store.write("packages", packages_now, mine)
        if differ:
            store.write("import_edges", resolved, mine)
        tell({"phase": "written", **result.counts})
    entry = spark.createDataFrame([(repo_id, root, start_ns)], "id string, root_path string, last_scanned bigint")
    old = repos.select("id", "name", "remote_url", "default_branch", "description")
    store.write("repos", entry.join(old, "id", "left").withColumn("name", F.coalesce("name", F.lit(repo_id))), [repo_id])
    store.end_work()
    result.seconds = time.time() - began
    tell({"phase": "done", **json.loads(json.dumps(vars(result)))})
    return result


def _parsed(store: Store, todo: DataFrame, chunks: tuple[int, int], total: int, tell: Callable[[dict], None]) -> DataFrame:
    """The parsed files as a table; a thread tells how many tasks' files are done while it is written."""
    count = store.spark.sparkContext.accumulator(0)

    def noted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count.add(len(pdf))
            yield pdf

    out = parse_files(todo, chunks).join(todo.select("path", "action"), "path")
    rows = out.mapInPandas(noted, out.schema)
    done, last = threading.Event(), 0

    def watch() -> None:
        nonlocal last
        while not done.wait(0.5):
            if count.value >= last + PROGRESS_FILES:
                last = count.value
                tell({"phase": "parsed", "files": min(last, total), "of": total})

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return store.work(rows)
    finally:
        done.set()
        watcher.join()
        tell({"phase": "parsed", "files": total, "of": total})


def due_nodes(nodes: DataFrame, model: str) -> DataFrame:
    """Nodes that have no vector, or one of another model."""
    return nodes.filter(F.col("embedding_code_vec").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)))


def embed_missing(store: Store, embed, model: str, settings: Settings | None = None) -> int:
    """Give a vector to every node that has none, or one of another model; equal texts are embedded once.

    Vectors come through the cache that the settings name, and only repositories with such
    nodes are written.
    """
    from .embedding import vectors_of

    text = X.embedding_text(F.col("docstring"), F.col("body"))
    due = due_nodes(store.read("nodes"), model).select("id", "repo_id", text.alias("_text")).filter("_text <> ''")
    due = store.work(due)
    n = due.count()
    if n:
        vectors = store.work(vectors_of(store, due.select(F.col("_text").alias("text")), embed, model, settings))
        got = due.join(vectors, F.col("_text") == F.col("text")).select(F.col("id").alias("_id"), F.col("vector").alias("_v"))
        for repo in [r[0] for r in due.select("repo_id").distinct().collect()]:  # repositories, not rows
            nodes = store.read("nodes", repo or "")
            out = nodes.join(got, F.col("id") == F.col("_id"), "left")
            pick = F.col("_v").isNotNull()
            out = out.withColumn("embedding_code_vec", F.when(pick, F.col("_v")).otherwise(F.col("embedding_code_vec"))).withColumn("embedding_model", F.when(pick, F.lit(model)).otherwise(F.col("embedding_model")))
            store.write("nodes", out.drop("_id", "_v"), [repo or ""])
    store.end_work()
    return n
