"""Row-level access to the store's tables: create, read, update, delete."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import filters as FT
from ..operators import snapshots as SN
from ..schema import Settings
from ..sources.store import Store
from ..sources.store import owner as owner_of
from .index import TextIndex
from .ingest import with_needles


class Table:
    """One table; every change writes the table's next snapshot.

    Changes take whole batches of rows: a batch is one snapshot, however many rows it
    has, and only the buckets of the repositories it touches are written.  Nodes keep
    the needles that their fields give.
    """

    def __init__(self, store: Store, name: str, settings: Settings | None = None):
        self.store, self.name, self.settings = store, name, settings or Settings()

    def all(self) -> DataFrame:
        return self.store.read(self.name)

    def get(self, ids: list[str]) -> DataFrame:
        return FT.by_values(self.all(), "id", ids)

    def find(self, **conditions: Any) -> DataFrame:
        """Rows by lists of values, ``has_embedding``, ``top_level``, ``limit`` and ``offset``."""
        return FT.optional(self.all(), **conditions)

    def first(self, **equal: Any) -> dict | None:
        row = FT.first_by(self.all(), **equal).first()
        return row.asDict() if row else None

    def create(self, rows: list[dict]) -> DataFrame:
        """Add rows; the union of their fields counts, and an id is made where there is none."""
        filled = [{"id": uuid.uuid4().hex, **r} for r in rows]
        if filled:
            new = self._frame(filled)
            self._write(lambda old: old.unionByName(new, allowMissingColumns=True), {self._owner(r) for r in filled}, new.select("id"))
        return self.get([r["id"] for r in filled])

    def update(self, rows: list[dict]) -> DataFrame:
        """Put non-null fields in place of the ones of the rows with the same ids."""
        ids = [r["id"] for r in rows]
        owners = self._owners(ids)
        if owners:
            changes = self._frame(rows).select(*dict.fromkeys(k for r in rows for k in r))
            moved = {self._owner(r) for r in rows if "repo_id" in r}
            self._write(lambda old: SN.update_rows(old, changes), owners | moved, changes.select("id"))
        return self.get(ids)

    def delete(self, ids: list[str]) -> None:
        owners = self._owners(ids)
        if owners:
            gone = self.store.spark.createDataFrame([(i,) for i in ids], "id string")
            self._write(lambda old: SN.delete(old, gone), owners)

    def _write(self, change: Callable[[DataFrame], DataFrame], owners: set[str], touched: DataFrame | None = None) -> None:
        """Apply a change to the rows of the repositories ``owners``; nodes in ``touched`` get new needles."""
        old = self.all().filter(owner_of(self.all().columns).isin(*owners))
        rows = change(old)
        if self.name == "nodes" and touched is not None:
            mine = touched.withColumnRenamed("id", "_t")
            made = with_needles(rows.join(mine, F.col("id") == F.col("_t"), "left_semi"), self.store.read("files"), self.settings)
            rows = rows.join(mine, F.col("id") == F.col("_t"), "left_anti").unionByName(made)
        self.store.write(self.name, rows, sorted(owners))

    def _owner(self, row: dict) -> str:
        fields = S.schema(self.name).fieldNames()
        return (row.get("repo_id") if "repo_id" in fields else row.get("id") if "root_path" in fields else "") or ""

    def _owners(self, ids: list[str]) -> set[str]:
        rows = self.all()
        return {r[0] for r in FT.by_values(rows, "id", ids).select(owner_of(rows.columns)).distinct().collect()}

    def _frame(self, rows: list[dict]) -> DataFrame:
        shape = S.schema(self.name)
        unknown = {k for r in rows for k in r} - set(shape.fieldNames())
        if unknown:
            raise ValueError(f"{self.name} has no {sorted(unknown)}")
        return self.store.spark.createDataFrame([tuple(r.get(f) for f in shape.fieldNames()) for r in rows], shape)


class Repository:
    """All tables, and what concerns several of them."""

    def __init__(self, store: Store, settings: Settings | None = None):
        self.store, self.settings = store, settings
        self.index = TextIndex(store)

    def refresh_indexes(self) -> None:
        """Let searches see the rows as they are now."""
        self.index.refresh()

    def __getattr__(self, name: str) -> Table:
        if name not in S.tables():
            raise AttributeError(name)
        return Table(self.store, name, self.settings)

    def link(self, project_id: str, repo_ids: list[str]) -> None:
        """Put repositories into a project; links that are there stay."""
        new = self.store.spark.createDataFrame([(f"{project_id}:{r}", project_id, r) for r in repo_ids], S.schema("project_repos"))
        self.store.write("project_repos", SN.insert_ignore(self.store.read("project_repos"), new, S.KEYS["project_repos"]))

    def repos_of(self, project_id: str) -> DataFrame:
        return FT.in_project(self.store.read("repos"), self.store.read("project_repos"), project_id)

    def drop_repos(self, repo_ids: list[str]) -> None:
        """Delete repositories with all their rows."""
        gone = self.store.spark.createDataFrame([(r,) for r in repo_ids], "id string")
        names = ("repos", "packages", "files", "nodes", "import_edges", "project_repos")
        for name, rows in SN.cascade({n: self.store.read(n) for n in names}, gone).items():
            mine = rows.filter(owner_of(rows.columns).isin(*repo_ids))
            self.store.write(name, mine, repo_ids)

    def drop_orphans(self) -> int:
        """Delete packages that no file points to; how many there were."""
        packages = self.store.read("packages")
        gone = FT.orphans(packages, self.store.read("files")).select("id").cache()
        n = gone.count()
        if n:
            self.store.write("packages", SN.delete(packages, gone))
        gone.unpersist()
        return n

    def migrate(self, steps: list[tuple[str, Callable[[Store], None]]]) -> list[str]:
        """Run the named steps that haven't run yet, in order, and record each."""
        done = {r["name"] for r in self.store.read("schema_versions").collect()}
        ran = []
        for name, step in steps:
            if name in done:
                continue
            step(self.store)
            row = self.store.spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("applied_at"))
            self.store.write("schema_versions", self.store.read("schema_versions").unionByName(row))
            ran.append(name)
        return ran
