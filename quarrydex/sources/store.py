"""The store: a folder of Parquet tables, each a series of snapshots.

A table's rows lie in ``BUCKETS`` by a hash of their repository, and a snapshot is a
small manifest that names each bucket's folder.  A write makes new folders for the
buckets it touches, then puts the next manifest in place by a rename that fails if
another writer came first; so readers see either the old rows or the new ones, a
failed write changes nothing, and what isn't touched isn't copied.  Folders that no
manifest names any more are kept for ``KEEP_S`` seconds for those who still read them.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import let_workers_import

BUCKETS, KEEP_S = 64, 3600
_MANIFEST = re.compile(r"v-(\d{12})\.json")


class StoreConflict(RuntimeError):
    """Another writer changed the table meanwhile; read again and repeat the change."""


class StoreDamaged(RuntimeError):
    """A table's files don't agree with its manifest; the message says what to do."""


def owner(columns: list[str]) -> Column:
    """The repository that a row belongs to; tables without one have a single bucket."""
    name = "repo_id" if "repo_id" in columns else "id" if "root_path" in columns else None
    return F.coalesce(F.col(name), F.lit("")) if name else F.lit("")


class Store:
    def __init__(self, spark: SparkSession, path: str, keep_s: float = KEEP_S):
        let_workers_import(spark)
        self.spark, self.path, self.keep_s = spark, path.rstrip("/"), keep_s

    # --- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[tuple[str, float]]:
        """(name, age in seconds) of what lies in a folder."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        now = time.time()
        return [(s.getPath().getName(), now - s.getModificationTime() / 1000) for s in fs.listStatus(p)]

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _manifest(self, table: str) -> tuple[int, dict[str, list[str]]]:
        """(version, folders of each bucket); version 0 without any."""
        versions = [int(m[1]) for name, _ in self._names(f"{self.path}/{table}") if (m := _MANIFEST.fullmatch(name))]
        if not versions:
            return 0, {}
        last = max(versions)
        try:
            return last, json.loads(self._text(f"{self.path}/{table}/v-{last:012d}.json"))
        except ValueError as e:
            raise StoreDamaged(f"manifest {last} of {table!r} can't be read ({e}); delete it to go back to the one before, then scan again") from e

    def _commit(self, table: str, version: int, buckets: dict[str, list[str]]) -> None:
        """Put the manifest after ``version`` in place."""
        name, draft = f"{self.path}/{table}/v-{version + 1:012d}.json", f"{self.path}/{table}/draft-{uuid.uuid4().hex[:12]}"
        fs, p = self._fs(draft)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(buckets).encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(p), fs.makeQualified(self._fs(name)[1]), options)
        except Exception as e:
            fs.delete(p, False)
            if fs.exists(self._fs(name)[1]):
                raise StoreConflict(f"{table!r} has a version {version + 1} already") from e
            raise

    # --- tables

    def read(self, table: str, repo: str | None = None) -> DataFrame:
        """The table's latest snapshot, of one repository or all; an empty table if there is none."""
        _, buckets = self._manifest(table)
        shape = S.schema(table)
        if repo is None:
            folders = [f for found in buckets.values() for f in found]
        else:
            folders = buckets.get(str(self._bucket(table, repo)), [])
        if not folders:
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).parquet(*[f"{self.path}/{table}/{f}" for f in folders])
        return rows if repo is None else rows.filter(owner(shape.fieldNames()) == repo)

    def write(self, table: str, rows: DataFrame, repos: list[str] | None = None) -> DataFrame:
        """Make ``rows`` the table's snapshot; columns they lack become null.

        With ``repos``, ``rows`` are all that these repositories shall have, and the rows
        of others stay without being copied, but for those that share a bucket.
        """
        version, old = self._manifest(table)
        shape = S.schema(table)
        have = set(rows.columns)
        rows = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) if f.name in have else _null(f) for f in shape])
        kept: dict[str, list[str]] = {}
        if repos is not None:
            touched = {str(self._bucket(table, r)) for r in repos}
            kept = {b: f for b, f in old.items() if b not in touched}
            beside = [f"{self.path}/{table}/{f}" for b in touched for f in old.get(b, [])]
            if beside:
                others = self.spark.read.schema(shape).parquet(*beside).filter(~owner(shape.fieldNames()).isin(*repos))
                rows = rows.unionAll(others)
        name = f"s-{uuid.uuid4().hex[:12]}"
        bucket = F.pmod(F.xxhash64(owner(shape.fieldNames())), F.lit(BUCKETS)).cast("int")
        rows = rows.withColumn("_bucket", bucket).hint("rebalance", F.col("_bucket"))
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{table}/{name}")
        made = {n.split("=")[1]: [f"{name}/{n}"] for n, _ in self._names(f"{self.path}/{table}/{name}") if n.startswith("_bucket=")}
        self._commit(table, version, kept | made)
        self.vacuum(table)
        return self.read(table)

    def _bucket(self, table: str, repo: str) -> int:
        columns = S.schema(table).fieldNames()
        owned = "repo_id" in columns or "root_path" in columns
        one = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(repo if owned else "")), F.lit(BUCKETS)).cast("int"))
        return one.first()[0]

    def vacuum(self, table: str) -> None:
        """Delete folders and manifests that no reader can need any more."""
        version, buckets = self._manifest(table)
        used = {f.split("/")[0] for found in buckets.values() for f in found}
        fs, _ = self._fs(self.path)
        for name, age in self._names(f"{self.path}/{table}"):
            m = _MANIFEST.fullmatch(name)
            stale = int(m[1]) < version if m else name not in used
            if stale and age > self.keep_s:
                fs.delete(self._fs(f"{self.path}/{table}/{name}")[1], True)

    def check(self) -> list[str]:
        """What is wrong with the store, each with advice; nothing if all tables can be read."""
        out = []
        for table in S.tables():
            try:
                _, buckets = self._manifest(table)
            except StoreDamaged as e:
                out.append(str(e))
                continue
            for f in (f for found in buckets.values() for f in found):
                fs, p = self._fs(f"{self.path}/{table}/{f}")
                if not fs.exists(p):
                    out.append(f"{table!r} lacks {f}; delete its newest manifest to go back to the one before, or scan again with a new store")
        return out

    def work(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a table of its own, so that nothing has to be computed again; ``end_work`` deletes them all."""
        path = f"{self.path}/_work/{uuid.uuid4().hex[:12]}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def end_work(self) -> None:
        fs, p = self._fs(f"{self.path}/_work")
        fs.delete(p, True)


def _null(f):
    return F.lit(1.0 if f.name == "search_boost" else None).cast(f.dataType).alias(f.name)
