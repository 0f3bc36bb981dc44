"""Where queries register themselves with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import let_workers_import

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (tables) under its name; ``tables("orders")`` reads a table."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            let_workers_import(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


WORDS = "regexp_extract_all({0}, '[A-Za-z0-9]+')"
_PIECES = (
    r"string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), "
    r"'([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), ' ')"
)


def words_sql(c: str) -> str:
    return WORDS.format(f"coalesce({c}, '')")


def code_sql(c: str) -> str:
    p = _PIECES.format("w")
    return f"flatten(list_transform({words_sql(c)}, lambda w: CASE WHEN len({p}) > 1 THEN list_concat([w], {p}) ELSE [w] END))"


def terms_sql(c: str) -> str:
    return f"list_transform({code_sql(c)}, lambda t: lower(t))"
