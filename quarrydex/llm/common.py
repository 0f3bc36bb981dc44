"""Scratch tables, worker set-up and small helpers shared by the operators.

Intermediate results that cut lineage are ordinary Parquet tables in the folder
named by ``spark.checkpoint.dir``; they survive the loss of executors and are
readable from every machine.  Only a session without that setting (tests on one
machine) gets a temporary folder.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: White space that separates words everywhere in this package.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch handed to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20
#: Set for Python workers, which are kept from stage to stage, so that freed memory goes back to the machine.
WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: What operators remember in a worker: a name and how to forget it.
_REMEMBERED: dict[str, Callable[[], None]] = {}
_LOCAL: list[str] = []
_REGISTERED: list[bool] = []


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and bound what one batch holds.

    The session keeps its own bounds where they are tighter.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for key, value in WORKER_ENV.items():
        env.setdefault(key, value)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def remember(name: str, forget: Callable[[], None]) -> None:
    """In a worker: ``name`` keeps something between tasks that ``forget`` drops."""
    _REMEMBERED[name] = forget


def begin(name: str) -> None:
    """In a worker: an operator's task begins; what other operators keep is dropped."""
    others = [k for k in _REMEMBERED if k != name]
    for k in others:
        _REMEMBERED.pop(k)()
    if others:
        gc.collect()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables of this application."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/quarrydex-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quarrydex-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results not read yet are lost."""
    p = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # Spark may have gone already
            drop_scratch(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and return a DataFrame that reads it.

    The tables are deleted when the driver ends, or by ``drop_scratch``.
    """
    if not _REGISTERED:
        _REGISTERED.append(True)
        atexit.register(_drop_at_exit)
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the scratch table behind a DataFrame returned by ``materialize``."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else, the same in every engine."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
