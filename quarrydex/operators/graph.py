"""Packages and imports: resolution, diffs, prefixes, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_imports(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """``edges`` with ``to_package_id``: by virtual path, else by physical path; external ones stay open."""
    virtual = packages.select(F.col("repo_id").alias("_r"), F.col("virtual_path").alias("_v"), F.col("id").alias("_by_virtual")).dropDuplicates(["_r", "_v"])
    physical = packages.select(F.col("repo_id").alias("_s"), F.col("physical_path").alias("_p"), F.col("id").alias("_by_physical")).dropDuplicates(["_s", "_p"])
    inside = ~F.coalesce(F.col("external"), F.lit(False))
    out = edges.join(virtual, (F.col("repo_id") == F.col("_r")) & (F.col("to_package_virtual_path") == F.col("_v")) & inside, "left")
    out = out.join(physical, (F.col("repo_id") == F.col("_s")) & (F.col("to_package_physical_path") == F.col("_p")) & inside, "left")
    keep = [c for c in edges.columns if c != "to_package_id"]
    old = [F.col("to_package_id")] if "to_package_id" in edges.columns else []
    return out.select(*keep, F.coalesce(*old, "_by_virtual", "_by_physical").alias("to_package_id"))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, action): keep, create or delete of every key; null keys match each other."""
    a = old.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.lit(1).alias("_old")).distinct()
    b = new.select(*keys, F.lit(1).alias("_new")).distinct()
    same = None
    for k in keys:
        part = F.col(f"_a_{k}").eqNullSafe(F.col(k))
        same = part if same is None else same & part
    joined = a.join(b, same, "full_outer")
    action = F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "delete").otherwise("update")
    return joined.select(*[F.when(F.col("_new").isNull(), F.col(f"_a_{k}")).otherwise(F.col(k)).alias(k) for k in keys], action.alias("action"))


def longest_prefix(items: DataFrame, prefixes: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """``items`` with the longest of ``prefixes`` that their path starts with.

    Instead of comparing every pair, an item looks its path's leading parts up:
    lengths that no prefix has are never tried.
    """
    lengths = prefixes.agg(F.sort_array(F.collect_set(F.length(prefix))).alias("_lens"))  # bounded by the longest path
    tried = items.withColumn("_row", F.monotonically_increasing_id()).crossJoin(F.broadcast(lengths)).withColumn("_lens", F.filter("_lens", lambda n: n <= F.length(path)))
    each = tried.withColumn("_try", F.explode_outer(F.transform("_lens", lambda n: F.substring(F.col(path), F.lit(1), n)))).drop("_lens")
    known = prefixes.select(F.col(prefix).alias("_try"), F.col(prefix).alias("_hit")).distinct()
    hits = each.join(known, "_try", "left").drop("_try")
    return hits.groupBy("_row", *items.columns).agg(F.max_by("_hit", F.length("_hit")).alias(prefix)).drop("_row")


def with_paths(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` (file_id, ...) with their files' paths and packages."""
    paths = files.select(F.col("id").alias("_f"), F.col("path").alias("file_path"), F.col("package_id").alias("file_package_id"))
    return rows.join(paths, F.col("file_id") == F.col("_f"), "left").drop("_f")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    newest = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return df.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
