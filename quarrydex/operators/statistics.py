"""Counters of scans and stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def phase_totals(rows: DataFrame, phase: str, seconds: str) -> DataFrame:
    """(phase, n, total, average, percent) of timed steps; percent is of all steps."""
    each = rows.groupBy(phase).agg(F.count("*").alias("n"), F.sum(seconds).alias("total"))
    whole = each.agg(F.sum("total").alias("_all"))  # one row
    out = each.crossJoin(F.broadcast(whole))
    return out.select(phase, "n", F.round("total", 6).alias("total"), F.round(F.col("total") / F.col("n"), 6).alias("average"), F.round(F.try_divide(100 * F.col("total"), F.col("_all")), 6).alias("percent"))


def action_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("action").agg(F.count("*").alias("n"))


def repo_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables in one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)
