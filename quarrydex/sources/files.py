"""Files of repositories: listing, ignore rules, dispatch to parsers, content."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.parsing.languages import extension_map


def relative(root: str, path: str = "path"):
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/")) + "/"
    return F.substring(F.regexp_replace(path, "^[a-z]+:/*", "/"), F.lit(len(base) + 1), F.length(path))


_LISTED = "path string, mtime bigint, length bigint"


def _local(root: str) -> str | None:
    """The local folder of a root, or null for another file system."""
    if re.match(r"^[a-z0-9]+:", root) and not root.startswith("file:"):
        return None
    return re.sub("^file:/*", "/", root).rstrip("/")


def list_tree(spark: SparkSession, root: str, paths: list[str] | None = None, newer_than: int | None = None, skip_dirs: tuple[str, ...] = ()) -> DataFrame:
    """(path, mtime, length) of the files below ``root``; times in nanoseconds.

    ``paths`` restricts the scan to files and folders inside the root; others are passed
    over.  Links aren't followed and folders named in ``skip_dirs`` aren't entered.
    Executors walk the folders, so the root must be mounted on all of them.  On a remote
    file system Spark lists instead, which leaves out names that begin with ``_`` or ``.``.
    """
    inside = [""] if paths is None else [p.strip("/") for p in paths if ".." not in p.split("/") and not p.startswith("/")]
    base = _local(root)
    if not inside:
        return spark.createDataFrame([], _LISTED)
    if base is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{root.rstrip('/')}/{p}" for p in inside])
        out = files.select(relative(root).alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime"), "length")
        return out if newer_than is None else out.filter(F.col("mtime") > newer_than)

    starts = []
    for p in inside:  # the first level is cut up here, so that folders spread over tasks
        full = os.path.join(base, p) if p else base
        if os.path.isdir(full):
            starts += [os.path.join(p, name) for name in sorted(os.listdir(full)) if name not in skip_dirs]
        elif os.path.isfile(full):
            starts.append(p)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple[str, int, int]] = []

            def add(path: str) -> None:
                try:
                    st = os.lstat(os.path.join(base, path))
                except OSError:
                    return
                if stat.S_ISREG(st.st_mode) and (newer_than is None or st.st_mtime_ns > newer_than):
                    rows.append((path, st.st_mtime_ns, st.st_size))  # noqa: B023

            for start in pdf["path"]:
                full = os.path.join(base, start)
                if os.path.islink(full) or not os.path.isdir(full):
                    add(start)
                    continue
                for folder, dirs, names in os.walk(full):
                    dirs[:] = [d for d in dirs if d not in skip_dirs]
                    rel = os.path.relpath(folder, base)
                    for name in names:
                        add(os.path.join(rel, name))
            yield pd.DataFrame(rows, columns=["path", "mtime", "length"])

    if not starts:
        return spark.createDataFrame([], _LISTED)
    parts = min(len(starts), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame([(x,) for x in starts], "path string").repartition(parts).mapInPandas(walk, _LISTED)


def _remote(root: str):
    """Opens files below a root on another file system, each by its own path."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    return lambda path: system.open_input_stream(f"{base.rstrip('/')}/{path}")


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, ...) with their bytes; files that can't be read any more are left out."""
    base = _local(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = (lambda path: open(os.path.join(base, path), "rb")) if base is not None else _remote(root)
        for pdf in batches:
            content = []
            for path in pdf["path"]:
                try:
                    with begin(path) as f:
                        content.append(f.read())
                except OSError:
                    content.append(None)
            yield pdf.assign(content=content).dropna(subset=["content"])

    columns = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInPandas(read, f"{columns}, content binary")


def read_tree(spark: SparkSession, root: str, paths: list[str] | None = None, newer_than: int | None = None) -> DataFrame:
    """(path, mtime, length, content) of the files below ``root``."""
    return with_content(list_tree(spark, root, paths, newer_than), root)


def ignored_by_dirs(files: DataFrame, dirs: list[str]) -> DataFrame:
    """Files with none of the given names among the parts of their path."""
    if not dirs:
        return files
    return files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in dirs])))


def compile_ignore(line: str) -> tuple[bool, bool, str] | None:
    """(negated, folders only, regular expression) of an ignore rule, relative to its file's folder."""
    rule = line.rstrip("\n").rstrip("\r")
    if not rule.endswith("\\ "):
        rule = rule.rstrip(" ")
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[negated:].removeprefix("\\") if negated or rule.startswith(("\\#", "\\!")) else rule
    folders = rule.endswith("/")
    rule = rule.rstrip("/")
    if not rule:
        return None
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = [], 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out.append("/.+")
            i += 3
        elif rule[i] == "*":
            out.append("[^/]*")
            i += 1
        elif rule[i] == "?":
            out.append("[^/]")
            i += 1
        elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
            body = rule[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            i += rule[i] == "\\" and i + 1 < len(rule)
            out.append(re.escape(rule[i]))
            i += 1
    return negated, folders, "^" + ("" if anchored else "(?:.*/)?") + "".join(out) + "$"


def ignore_rules(tree: DataFrame) -> DataFrame:
    """(folder, rank, negated, folders, regex) of all ignore files of a tree (path, content)."""

    @F.pandas_udf("array<struct<rank:int,negated:boolean,folders:boolean,regex:string>>")
    def rules(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = [(i, compile_ignore(line)) for i, line in enumerate((text or "").split("\n"))]
            out.append([{"rank": i, "negated": r[0], "folders": r[1], "regex": r[2]} for i, r in found if r])
        return pd.Series(out)

    files = tree.filter(F.col("path").rlike(r"(^|/)\.gitignore$"))
    folder = F.regexp_replace("path", r"/?\.gitignore$", "")
    return files.select(folder.alias("folder"), F.explode(rules(F.col("content").cast("string"))).alias("r")).select("folder", "r.*")


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no rule takes out.

    Each path and each folder above it is judged by the rules of the folders above
    that: the last rule of the deepest folder wins, and what lies in an ignored folder
    stays ignored.  Paths meet rules in an equi-join on the folder.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("prefix"), (n < F.size(parts)).alias("is_dir")))
    each = files.select(F.explode(prefixes).alias("x")).select("x.*").distinct()
    up = F.split("prefix", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(up) - 1), lambda n: F.when(n == 0, "").otherwise(F.array_join(F.slice(up, 1, n), "/")))
    asked = each.withColumn("folder", F.explode(folders)).withColumn("depth", F.when(F.col("folder") == "", 0).otherwise(F.length("folder") + 1))
    met = asked.join(rules, "folder").filter((~F.col("folders") | F.col("is_dir")) & F.expr("substring(prefix, depth + 1) RLIKE regex"))
    verdict = met.groupBy("prefix", "is_dir").agg(F.max_by("negated", F.struct("depth", "rank")).alias("spared")).filter("NOT spared")
    mine = files.select("path", F.explode(prefixes).alias("x")).select("path", "x.*")
    gone = mine.join(verdict, ["prefix", "is_dir"]).select("path").distinct()
    return files.join(gone, "path", "left_anti")


def parser_of(files: DataFrame, override: dict[str, str] | None = None, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """``files`` with the ``parser`` of their extension, null without one."""
    table = F.create_map(*[F.lit(x) for pair in sorted(extension_map(extra, override).items()) for x in pair])
    return files.withColumn("parser", table[P.suffix(F.col("path"))])
