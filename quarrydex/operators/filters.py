"""Look-ups and filters of the store's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer lists of keys go into a semi-join instead of an IN list.
IN_LIMIT = 1000


def by_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is in a list; an empty list finds nothing."""
    if not values:
        return df.filter(F.lit(False))
    if len(values) <= IN_LIMIT:
        return df.filter(F.col(column).isin(values))
    kind = df.schema[column].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(v,) for v in set(values)], f"_v {kind}")
    return df.join(wanted, F.col(column) == F.col("_v"), "left_semi")


def first_by(df: DataFrame, **equal) -> DataFrame:
    """The first row (by id) with the given column values."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == value)
    return df.orderBy("id").limit(1)


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def optional(df: DataFrame, *, has_embedding: bool | None = None, top_level: bool = False, limit: int | None = None, offset: int = 0, **lists) -> DataFrame:
    """Rows that satisfy every condition given; null and empty lists don't filter.

    ``lists`` are column=values.  With a limit or offset, rows come in the order of id.
    """
    parts = [F.col(name).isin(list(values)) for name, values in lists.items() if values]
    if has_embedding is not None:
        vector = F.col("embedding_code_vec")
        parts.append(vector.isNotNull() if has_embedding else vector.isNull())
    if top_level:
        parts.append(F.col("parent_node_id").isNull())
    out = df.filter(conjunction(parts))
    if limit is not None or offset:
        out = out.orderBy("id")
        out = out.offset(offset) if offset else out
        out = out.limit(limit) if limit is not None else out
    return out


def in_project(repos: DataFrame, project_repos: DataFrame, project_id) -> DataFrame:
    """Repositories of a project."""
    mine = project_repos.filter(F.col("project_id") == project_id)
    return repos.join(mine, repos["id"] == mine["repo_id"], "left_semi")


def orphans(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Packages that no file points to."""
    return packages.join(files.select(F.col("package_id").alias("_p")), F.col("id") == F.col("_p"), "left_anti")
