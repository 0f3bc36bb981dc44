"""Snapshot maintenance: upserts, updates, deletes, change detection, cache eviction.

A table is a snapshot of Parquet files; every operation returns the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_hash(content: str | Column) -> Column:
    """What tells one file content from another: its SHA-256."""
    return F.sha2(content, 256)


def duplicates(rows: DataFrame, content: str, id_col: str) -> DataFrame:
    """(digest, n, first) of contents that several rows have."""
    each = rows.groupBy(content_hash(content).alias("digest")).agg(F.count("*").alias("n"), F.min(id_col).alias("first"))
    return each.filter("n > 1")


def high_water(files: DataFrame, time_col: str = "last_updated", key: str = "repo_id") -> DataFrame:
    """(key, last_scanned): the newest time that each repository's files have."""
    return files.groupBy(key).agg(F.max(time_col).alias("last_scanned"))


def cache_sizes(cache: DataFrame) -> DataFrame:
    """(model, n): the vectors that each model's cache holds."""
    return cache.groupBy("model").agg(F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and the rows of ``old`` that it doesn't replace; missing columns become null."""
    gone = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = None
    for i, k in enumerate(keys):
        part = F.col(k) == F.col(f"_k{i}")
        same = part if same is None else same & part
    return old.join(gone, same, "left_anti").unionByName(new, allowMissingColumns=True)


def update_rows(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with the non-null values of ``changes`` in place of theirs."""
    values = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in values])
    joined = rows.join(new, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in rows.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it doesn't have; one row a key."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def delete(rows: DataFrame, gone: DataFrame, column: str = "id", key: str = "id") -> DataFrame:
    """``rows`` whose ``column`` isn't among ``gone``'s keys."""
    return rows.join(gone.select(F.col(key).alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")


def cascade(tables: dict[str, DataFrame], repo_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the given repositories."""
    return {name: delete(df, repo_ids, "id" if name == "repos" else "repo_id") for name, df in tables.items()}


def changes(seen: DataFrame, stored: DataFrame, high_water: int | None) -> DataFrame:
    """(path, mtime, hash, action) of seen files: unseen, skip, update or insert.

    A file not newer than the high-water mark isn't looked at; a stored file is
    skipped if its time isn't newer, or if its content is the same.
    """
    old = stored.select(F.col("path").alias("_p"), F.col("last_updated").alias("_t"), F.col("file_hash").alias("_h"))
    candidate = F.lit(True) if high_water is None else F.col("mtime") > high_water
    action = (
        F.when(~candidate, "unseen")
        .when(F.col("_p").isNull(), "insert")
        .when(F.col("_t") >= F.col("mtime"), "skip")
        .when(F.col("_h") == F.col("hash"), "skip")
        .otherwise("update")
    )
    return seen.join(old, F.col("path") == F.col("_p"), "left").select(*seen.columns, action.alias("action"))


def vanished(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored files that a full scan didn't see."""
    return stored.join(seen.select("path"), "path", "left_anti")


def reuse_embeddings(new: DataFrame, old: DataFrame, text: str = "text") -> DataFrame:
    """``new`` with the vector of the last old row of the same file and text, if any."""
    last = Window.partitionBy("_f", "_h").orderBy(F.desc("_o"))
    known = old.select(F.col("file_id").alias("_f"), F.sha2(text, 256).alias("_h"), F.col("vector"), F.col("ordinal").alias("_o"))
    known = known.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("_f", "_h", "vector")
    return new.join(known, (F.col("file_id") == F.col("_f")) & (F.sha2(text, 256) == F.col("_h")), "left").drop("_f", "_h")


def lru_victims(cache: DataFrame, max_rows: int, batch: int, span_s: int = 600) -> DataFrame:
    """Rows to drop from each model's cache: the oldest, as many as are over or a batch.

    Rows are counted by spans of ``span_s`` seconds of their last use; only the span in
    which the last victim lies is sorted, so no task orders a whole cache.
    """
    rows = cache.withColumn("_s", F.floor(F.unix_micros(F.col("last_accessed").cast("timestamp")) / (span_s * 1_000_000)))
    spans = rows.groupBy("model", "_s").agg(F.count("*").alias("_n"))
    each = Window.partitionBy("model")
    spans = spans.withColumn("_over", F.sum("_n").over(each) - max_rows).withColumn("_before", F.sum("_n").over(each.orderBy(F.asc_nulls_first("_s"))) - F.col("_n"))
    spans = spans.filter("_over > 0").withColumn("_left", F.greatest(F.lit(batch), F.col("_over")) - F.col("_before")).filter("_left > 0")
    due = spans.select(F.col("model").alias("_m"), F.col("_s").alias("_t"), "_n", "_left")
    met = rows.join(due, (F.col("model") == F.col("_m")) & F.col("_s").eqNullSafe(F.col("_t")))
    whole = met.filter("_n <= _left")
    order = Window.partitionBy("model").orderBy(F.asc_nulls_first("last_accessed"), "id")
    part = met.filter("_n > _left").withColumn("_i", F.row_number().over(order)).filter("_i <= _left")
    return whole.select(*cache.columns).unionAll(part.select(*cache.columns))


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` (model, hash) with the cached vector, null where there is none."""
    return wanted.join(cache.select("model", "hash", "vector").dropDuplicates(["model", "hash"]), ["model", "hash"], "left")


def cache_store(cache: DataFrame, new: DataFrame, now) -> DataFrame:
    """The cache with new vectors and the access times of those used touched."""
    fresh = new.withColumn("last_accessed", F.lit(now))
    return upsert(cache, fresh, ["model", "hash"])


def touch(cache: DataFrame, used: DataFrame, now) -> DataFrame:
    mark = used.select("model", "hash", F.lit(True).alias("_used")).distinct()
    stamped = cache.join(mark, ["model", "hash"], "left")
    return stamped.withColumn("last_accessed", F.when(F.col("_used"), F.lit(now)).otherwise(F.col("last_accessed"))).drop("_used").select(*cache.columns)
