"""Session set-up with the settings that the engine's plans assume."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def let_workers_import(spark: SparkSession) -> None:
    """Put this package on the path of Python workers that start from now on."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is a scan of fewer partitions than there are cores.

    A small table in one row group would keep one core busy; a table of many files
    is left as it is, without a shuffle.  Rows go by a hash of their first column, which
    needs no sort as dealing them out in turn does.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.isStreaming or "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, df.columns[0])


#: Partitions that a large shuffle may have before adaptive execution joins the small ones, and to what size it joins them.
MOST_TASKS, TASK_BYTES = 512, 16 << 20


def many_tasks(spark: SparkSession) -> None:
    """Let large shuffles have more partitions than the session's number, so that a task's share stays small."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(key, None) is None and int(spark.conf.get("spark.sql.shuffle.partitions")) < MOST_TASKS:
        spark.conf.set(key, MOST_TASKS)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(size) == "67108864b":  # Spark's own, not the session's
        spark.conf.set(size, TASK_BYTES)


def build(master: str | None = None, app: str = "quarrydex", **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    let_workers_import(spark)
    return spark
