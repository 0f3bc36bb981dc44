"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets come from one row per source.  Each source's rows fall into blocks by a
seeded hash, the blocks are permuted, and whole passes plus a run of permuted blocks
give the source its exact quota of blocks; rows of the one block at the edge settle
the last words.  A tree over the output shards splits the quotas: a node draws how
many of each source's blocks go to its left half from the hypergeometric law given
what is left, so every shard gets an exact, jointly random quota, and takes the next
run of each source's permuted blocks.  Only block and source tables are windowed or
folded; documents meet them in equi-joins on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_SEPARATORS, materialize

SHARDS, SEED, MOST_PASSES = 16, 6, 3
#: Rows of a block, and blocks that a source has at most.
BLOCK_ROWS, MOST_BLOCKS = 64, 1 << 16
#: Tasks that shuffle one output shard.
PIECES = 4
#: Single rows that may bring a source nearer to its target in the end.
NEAREST = 6


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    closed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_SEPARATORS, " "))
    return F.when(closed == "", F.lit(0)).otherwise(F.length(closed) - F.length(F.replace(closed, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, most: float = MOST_PASSES) -> DataFrame:
    """(source, n_rows, source_size, rank, target) of a table (source, size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the total size;
    none gets over ``most`` times its own, and what it can't take goes to the others
    by weight.  Sorted by the ratio of limit to weight, a source is at its limit
    exactly if its fair share of what its predecessors leave would be over it.
    """
    total = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = total.withColumn("rank", F.row_number().over(order)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    limit = F.lit(float(most)) * F.col("source_size")
    fill = Window.orderBy("ratio", "rank")
    ranked = ranked.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy(F.lit(1))
    ranked = (
        ranked.withColumn("all", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("limits_before", F.sum("limit").over(fill) - F.col("limit"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(fill) + F.col("weight"))
        .withColumn("share", (F.col("all") - F.col("limits_before")) / F.col("weight_left"))
        .withColumn("full", F.col("ratio") <= F.col("share"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct("ratio", "rank", "share"))).over(everything)["share"])
    )
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return ranked.select("source", "n_rows", "source_size", "rank", target.alias("target"))


def _hypergeometric(good: str, total: str, draws: str, uniform: str) -> str:
    """SQL for the number of ``good`` items among ``draws`` of ``total``, at a uniform number.

    Terms are built from the mode outwards by their ratios, to where they vanish in
    double precision; the draw walks up, then down, through the same terms.
    """
    up = "w * (p.k - x) * (p.n - x) / ((x + 1.0D) * (p.t - p.k - p.n + x + 1.0D))"
    down = "w * x * (p.t - p.k - p.n + x) / ((p.k - x + 1.0D) * (p.n - x + 1.0D))"
    reach = "cast(12 * sqrt(p.n * p.k / p.t * (p.t - p.k) / p.t * (p.t - p.n) / greatest(p.t - 1, 1D)) + 40 as bigint)"
    mode = "cast(floor((p.n + 1) * (p.k + 1) / (p.t + 2)) as bigint)"
    ups = "filter(sequence(q.m, greatest(q.m, q.hi)), v -> v < q.hi)"
    downs = "filter(sequence(q.m, least(q.m, q.lo)), v -> v > q.lo)"

    def walk(span: str, step: str, move: str, offset: str) -> str:
        term = step.replace("x", "cast(v as double)").replace("ecast(v as double)p", "exp").replace("w *", "a.w *")
        return (
            f"aggregate({span}, named_struct('w', 1.0D, 's', {offset}, 'at', cast(null as bigint)), (a, v) -> transform(array({term}), y -> named_struct('w', y, 's', a.s + y, "
            f"'at', if(a.at is null and a.s + y > q.u, v {move} 1, a.at)))[0])"
        )

    def bind(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    edges = f"named_struct('m', {mode}, 'lo', greatest(0L, cast(p.n + p.k - p.t as bigint), {mode} - {reach}), 'hi', least(cast(p.n as bigint), cast(p.k as bigint), {mode} + {reach}), 'u', 2D)"
    mass = bind("q", edges, f"named_struct('m', q.m, 'lo', q.lo, 'hi', q.hi, 'u', p.u * (1D + ({walk(ups, up, '+', '0D')}).s + ({walk(downs, down, '-', '0D')}).s))")
    # 'u' above is an impossible mark for the first walks: they only sum
    mass = mass.replace("> q.u", "> 1D / 0.5D * double('inf')")
    draw = bind("q", mass, f"if(q.u < 1D, q.m, {bind('r', walk(ups, up, '+', '1D'), f'coalesce(r.at, {bind("z", walk(downs, down, "-", "r.s"), "coalesce(z.at, q.m)")})')})")
    given = f"named_struct('k', cast({good} as double), 't', cast({total} as double), 'n', cast({draws} as double), 'u', {uniform})"
    return f"if({total} <= 0 or {draws} <= 0, 0L, if({draws} >= {total}, {good}, {bind('p', given, draw)}))"


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, starts): from which of a source's permuted blocks each shard takes its run.

    ``quotas`` is (source, rank, quota); ``starts`` has ``shards + 1`` ascending
    numbers from 0 to the quota.  A node of the tree holds a range of shards and
    folds over the sources, so a node's draws are jointly hypergeometric.
    """
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", F.col("quota").cast("long").alias("quota")))).alias("q"))
    nodes = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.transform("q", lambda x: x["rank"]).alias("ranks"), F.transform("q", lambda x: x["quota"]).alias("q"))
    depth = max(0, (shards - 1).bit_length())
    for level in range(depth):
        half = "(lo + hi) div 2"
        uniform = f"(shiftrightunsigned(xxhash64({seed}, {level}, lo, a.i), 11) + 0.5D) / 9007199254740992D"
        draw = _hypergeometric("k", "a.t", "a.n", uniform)
        fold = (
            "aggregate(q, named_struct('t', aggregate(q, 0L, (s, k) -> s + k), 'n', aggregate(q, 0L, (s, k) -> s + k) * (" + half + " - lo) div (hi - lo), 'i', 0, 'out', cast(array() as array<bigint>)), "
            f"(a, k) -> transform(array({draw}), x -> named_struct('t', a.t - k, 'n', a.n - x, 'i', a.i + 1, 'out', concat(a.out, array(x))))[0], a -> a.out)"
        )
        drawn = nodes.withColumn("left", F.when(F.expr("hi - lo > 1"), F.expr(fold)))
        parts = F.expr(
            f"if(hi - lo > 1, array(named_struct('lo', lo, 'hi', {half}, 'q', left), named_struct('lo', {half}, 'hi', hi, 'q', zip_with(q, left, (x, y) -> x - y))), array(named_struct('lo', lo, 'hi', hi, 'q', q)))"
        )
        nodes = drawn.select("ranks", F.explode(parts).alias("p")).select("p.lo", "p.hi", "ranks", "p.q")
    each = nodes.select("lo", F.explode(F.arrays_zip("ranks", "q")).alias("x")).select("lo", F.col("x.ranks").alias("rank"), F.col("x.q").alias("n"))
    runs = each.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("lo", "n"))).alias("s"))
    starts = F.aggregate("s", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["n"])))
    return runs.select("rank", starts.alias("starts"))


def plan(
    rows: DataFrame, *, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS, most: int = MOST_PASSES
) -> DataFrame:
    """``rows`` (row, doc_id, source, size, content, ...) with ``source_size``, ``target``, ``copies`` and ``shards``.

    ``shards`` lists the output shard of each copy.  Sources of no words have target
    0 and no copies.  ``content`` is a hash of the text; ``row`` only settles the order of
    rows of equal source, id and text, so no result depends on how the rows are stored.
    """
    by_source = materialize(targets(rows, most), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    blocks = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n_rows") / block_rows)).cast("int")
    source = by_source.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("blocks", blocks)
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "content")
    source = source.withColumnRenamed("source", "_source")
    placed = rows.join(source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("key", key)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    in_source = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), "rank", "block"), "block")
    block = placed.groupBy("rank", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    block = block.withColumn("place", F.row_number().over(in_source) - 1).withColumn("upto", F.sum("words").over(in_source))
    block = materialize(
        block.withColumn("whole", F.col("upto") <= F.col("rest"))
        .withColumn("edge", ~F.col("whole") & (F.col("upto") - F.col("words") < F.col("rest")))
        .withColumn("room", F.col("rest") - (F.col("upto") - F.col("words"))),
        "blocks",
    )
    # the block at the edge: its rows in permuted order while they fit, then the largest that fit, last the one that
    # comes nearest; a row may be taken again while it isn't over its most passes
    edge = placed.select("rank", "block", "row", "size", "doc_id", "key", "passes").join(block.filter("edge AND room > 0").select("rank", "block", "room"), ["rank", "block"])
    order = Window.partitionBy("rank").orderBy("key", "doc_id", "row")
    edge = edge.withColumn("took", F.when(F.sum("size").over(order) <= F.col("room"), 1).otherwise(0))
    for k in range(NEAREST):
        left = F.col("room") - F.sum(F.col("size") * F.col("took")).over(Window.partitionBy("rank"))
        edge = edge.withColumn("left", left).withColumn("miss", F.abs(F.col("size") - F.col("left"))).withColumn("full", F.col("took") + F.col("passes") >= most)
        over = F.col("size") > F.col("left") if k + 1 < NEAREST else F.lit(False)
        best = F.row_number().over(Window.partitionBy("rank").orderBy("full", over, "miss", "key", "doc_id", "row"))
        edge = edge.withColumn("over", over).withColumn("best", best).withColumn("took", F.expr("took + if(best = 1 AND NOT full AND NOT over AND miss < abs(left), 1, 0)"))
    extra = edge.filter("took > 0").select("row", F.col("took").alias("extra"))

    used = F.when(F.col("whole"), 1).otherwise(0)
    quota = block.groupBy("rank", "passes").agg((F.count("*") * F.col("passes") + F.sum(used) + F.max(F.when(F.col("edge"), 1).otherwise(0))).alias("quota"), F.count("*").alias("n_blocks"))
    quota = materialize(quota.join(shard_quotas(quota.select("rank", "quota"), shards, seed), "rank").select("rank", "starts", "n_blocks"), "quotas")
    spot = block.select("rank", "block", "place", "whole").join(quota, "rank")
    out = placed.join(spot, ["rank", "block"]).join(extra, "row", "left").withColumn("copies", F.col("passes") + F.when(F.col("whole"), 1).otherwise(F.coalesce("extra", F.lit(0))))
    # copy c of a row is item c * n_blocks + place of its source's permuted blocks; copies at the edge beyond the first go with it
    shard = "transform(filter(sequence(0, greatest(copies, 1) - 1), c -> c < copies), c -> cast(size(filter(starts, s -> s <= least(c, passes) * n_blocks + place)) - 1 as int))"
    extra_columns = [c for c in rows.columns if c not in ("row", "doc_id", "source", "size", "content")]
    return out.select("row", "doc_id", "source", "size", *extra_columns, "source_size", "target", "copies", F.expr(shard).alias("shards"), "key")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """Per document: size, its source's size and target, the words taken and the copies' shards.

    Null texts have size 0 and may be taken any number of times without words; a null
    source is a source of its own.  Repeated rows are separate rows.  Every row of
    ``docs`` gives one row.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("content")), "sizes")
    out = plan(rows, **options)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "shards")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, shards: int = SHARDS, pieces: int = PIECES, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` once per copy taken, with ``shard`` and ``slot``.

    ``slot`` orders a shard's rows at random; every shard is shuffled by itself.  The
    rows come laid out: a task holds one of a shard's ``pieces`` in order of its slots, so
    that files written from the result are shuffled too.  Null texts, null sources
    and repeated rows as above; columns named ``shard`` or ``slot`` are replaced.
    """
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    whole = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("_r")), "mixed")
    slim = whole.select("row", F.col(f"_r.{id_col}").alias("doc_id"), F.col(f"_r.{source_col}").alias("source"), word_count(F.col(f"_r.{text_col}")).alias("size"), F.xxhash64(f"_r.{text_col}").alias("content"))
    chosen = plan(materialize(slim, "sizes"), shards=shards, seed=seed).filter("copies > 0").select("row", "key", "shards")
    each = whole.join(chosen, "row").select("_r", "key", "row", F.posexplode("shards").alias("_copy", "shard"))
    placed = each.select("_r.*", "shard", F.xxhash64(F.lit(seed), "shard", "key", "_copy").alias("slot"))
    piece = F.pmod("slot", F.lit(pieces)).cast("int") + F.col("shard") * pieces
    return placed.repartitionById(shards * pieces, piece).sortWithinPartitions("shard", "slot")


def source_targets(docs: DataFrame) -> DataFrame:
    """(source, n_rows, source_size, target) of a table of documents."""
    found = targets(docs.select("source", word_count(F.col("text")).alias("size")))
    return found.select("source", "n_rows", "source_size", F.round("target", 6).alias("target"))


TARGETS_SQL = rf"""
WITH s AS (SELECT source, count(*) AS n_rows, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS size FROM documents GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, {MOST_PASSES}.0 * size AS most FROM s),
f AS (SELECT *, (sum(size) OVER () - (sum(most) OVER w - most)) / (sum(weight) OVER () - sum(weight) OVER w + weight) AS share, row_number() OVER w AS k FROM r WINDOW w AS (ORDER BY most / weight, source)),
g AS (SELECT *, most / weight <= share AS capped FROM f)
SELECT source, n_rows, size AS source_size, round(CASE WHEN capped THEN most ELSE least(most, weight * (SELECT min_by(share, k) FROM g WHERE NOT capped)) END::DOUBLE, 6) AS target FROM g
"""
