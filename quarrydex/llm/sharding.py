"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters records over buckets of a memory's size by a seeded hash of their
content.  Pass two puts each bucket, in order of that hash, into an array and permutes
it with the engine's seeded Fisher-Yates shuffle; bucket ``b`` is partition ``b``, so its
random numbers depend on the seed and ``b`` alone.  So places depend on the records, not
on the files or tasks that held them, and a recomputed task gives the same order.
Records that are equal in all columns are numbered and scattered by their numbers.  Buckets
follow each other, and the sequence is cut into shards whose row counts differ by
one at most: a bucket goes to one shard or to neighbouring ones, with no third pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

SHARDS = 40
#: Bytes and rows of a bucket.
BUCKET_BYTES, BUCKET_ROWS = 64 << 20, 1 << 18
SEED = 20
_ROW_BYTES = 16


def size_of(text):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + _ROW_BYTES).cast("long")


def shuffle_into_shards(
    records: DataFrame, size_col: str, *, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``records`` with ``shard`` (from 0) and ``slot`` (from 0, without gaps, in each shard).

    ``size_col`` holds each record's bytes and sets only how many buckets there are.
    Every row gets a place of its own, repeated rows and null ids too; rows that are
    equal in all columns may change places with each other, and no others.  With fewer
    rows than shards some shards stay empty.  Columns named ``shard`` or ``slot`` are
    replaced.
    """
    columns = sorted(c for c in records.columns if c not in ("shard", "slot"))
    hashed = lambda salt: F.xxhash64(F.lit(salt), *columns, *[F.col(c).isNull() for c in columns])
    rows = records.select(F.monotonically_increasing_id().alias("_row"), F.spark_partition_id().alias("_task"), hashed(seed).alias("_k"), hashed(~seed).alias("_l"), F.struct(*columns).alias("_r"))
    rows = materialize(rows, "records")
    # equal records get numbers, by task first so that no task has to number all of a large group
    per_task = rows.groupBy("_k", "_l", "_task").agg(F.count("*").alias("_n"))
    several = per_task.groupBy("_k", "_l").agg(F.sum("_n").alias("_all")).filter("_all > 1").drop("_all")
    base = F.sum("_n").over(Window.partitionBy("_k", "_l").orderBy("_task")) - F.col("_n")
    bases = per_task.join(several, ["_k", "_l"]).withColumn("_base", base).drop("_n")
    within = F.row_number().over(Window.partitionBy("_k", "_l", "_task").orderBy("_row")) - 1
    numbered = rows.select("_k", "_l", "_task", "_row").join(bases, ["_k", "_l", "_task"]).select("_row", (F.col("_base") + within).alias("_number"))
    rows = materialize(rows.join(numbered, "_row", "left").withColumn("_number", F.coalesce("_number", F.lit(0))).drop("_task"), "numbered")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(f"_r.{size_col}"), F.lit(0)).alias("bytes")).first()
    n = total["n"]
    buckets = max(1, -(-total["bytes"] // bucket_bytes), -(-n // bucket_rows))
    scattered = rows.withColumn("_b", F.pmod(F.xxhash64("_k", "_number", F.lit(seed)), F.lit(buckets)).cast("int"))
    filled = scattered.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("_k", "_l", "_number", "_row", "_r"))).alias("_rows"))
    shuffled = filled.repartitionById(buckets, F.col("_b")).select("_b", F.shuffle("_rows", seed).alias("_rows"))
    counts = scattered.groupBy("_b").count()
    before = counts.select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_before"))
    placed = shuffled.select("_b", F.posexplode("_rows").alias("_i", "_x")).join(before, "_b")
    at = placed.select(F.col("_x._r").alias("_r"), (F.col("_before") + F.col("_i")).cast("long").alias("_at")).withColumn("shard", F.expr(f"cast(_at * {shards} div {max(n, 1)} as int)"))
    # the first position p with p * shards div n = shard is ceil(shard * n / shards)
    slot = F.expr(f"_at - (cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return at.select(*[F.col("_r")[c].alias(c) for c in columns], "shard", slot.alias("slot"))


def assign_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document's place under the ``rows`` law; null texts are empty, repeated rows have a place each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # what is moved here is narrow, whatever the texts' sizes: rows alone say how many buckets there are
    return shuffle_into_shards(records, "size", shards=shards, bucket_bytes=1 << 62).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, text_col: str = "text", *, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write whole documents to ``path/shard=<k>``, in slot order within each file.

    Nulls anywhere, repeated rows and empty tables as above.
    """
    sized = docs.withColumn("_size", size_of(F.col(text_col)))
    placed = shuffle_into_shards(sized, "_size", shards=shards, seed=seed).drop("_size")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
