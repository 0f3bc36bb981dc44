"""Ranks of the rows that may come first in a fusion, without ranking the others.

A fused score is a boost times a sum of weight / (k + rank), so a row that is among the
best of no ranking can't pass a bound.  Workers keep each query's best rows; the ranks of
these candidates are found by counting, on the workers too, how many rows are ahead of
them.  Queries whose best rows the bound doesn't settle are asked again for more
candidates, and what is left then is ranked whole.  Ranks and results are those of
``search.ranked`` and ``search.fuse``.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from ..session import many_tasks, spread
from . import search as S

#: (query, candidate) pairs of a ranking that the driver holds, and bytes of the queries' vectors.
MOST_CANDIDATES, MOST_VECTOR_BYTES = 1_000_000, 64 << 20
#: Candidates a query at least, and how many times more it is asked for when these don't settle it.
LEAST_CANDIDATES, GROWTH = 100, 16
#: More than what rounding to nine decimals can move two scores towards each other.
ROUNDING = 1.1e-9

#: (ids, which of them may come in the result, row, query, score) of a batch; a choice of ids limits it to these.
Scored = Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
Scorer = Callable[[pa.RecordBatch, Callable[[pa.Array], np.ndarray] | None], Scored]


@dataclass
class Prepared:
    """Kept rows, the queries in the order of their numbers, and what makes a worker's scorer."""

    rows: DataFrame
    query_ids: list
    scorer: Callable[[], Scorer]


@dataclass
class Scoring:
    """Scores of ``rows`` (id, value and, if ``of_nodes``, all columns of the nodes) that can be reckoned repeatedly.

    ``whole`` gives (query_id, id, score).  ``prepare`` takes (id, value, wanted); it gives
    none where ids or queries repeat, or there are too many queries.
    """

    rows: DataFrame
    whole: Callable[[], DataFrame]
    prepare: Callable[[DataFrame], Prepared | None]
    query_type: T.DataType
    of_nodes: bool = False


def text_scoring(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, kind: str = "code", k: float = S.K1, b: float = S.B, of_nodes: bool = False) -> Scoring:
    """``search.document_bm25``; texts are read once, and counts of the needles' terms are kept on the workers' disks."""

    def prepare(flagged: DataFrame) -> Prepared | None:
        many_tasks(docs.sparkSession)
        asked = S._asked_terms(terms)
        if kind == "noop" or asked is None or not S._distinct_ids(docs, id_col):
            return None
        words, query_ids, pairs = asked
        n_queries = len(query_ids)
        shared = docs.sparkSession.sparkContext.broadcast(words)
        at_once = max(1, min(S.POSTED_DOCUMENTS, S.SCORED_PAIRS // max(1, n_queries)))

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = X.term_counter(kind, shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, at_once):
                    some = batch.slice(at, at_once)
                    sizes, owners, codes, tfs = S._counted(some.column(1), count)
                    each = (sizes, np.bincount(owners, minlength=len(sizes)), codes, tfs)
                    posted = pickle.dumps([x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in each])
                    wanted = some.column(2).to_numpy(zero_copy_only=False).astype(bool).tobytes()
                    ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some.column(0))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([wanted], pa.binary()), pa.array([posted], pa.binary())], names=["ids", "wanted", "posted"])

        def counts(posted: pa.Scalar) -> Iterator[np.ndarray]:
            return (x.astype(np.int64) for x in pickle.loads(posted.as_py()))

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n, length = np.zeros(len(words), np.int64), 0, 0
            for batch in batches:
                for posted in batch.column(2):
                    sizes, _, codes, _ = counts(posted)
                    df += np.bincount(codes, minlength=len(df))
                    n, length = n + len(sizes), length + int(sizes.sum())
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, length], df[some]]))], names=["code", "n"])

        key = flagged.schema["id"].dataType.simpleString()
        rows = spread(flagged).mapInArrow(post, f"ids array<{key}>, wanted binary, posted binary").persist(StorageLevel.DISK_ONLY)
        mean, idf = S._corpus_weights(rows.mapInArrow(tally, "code bigint, n bigint"), len(words))
        weights = docs.sparkSession.sparkContext.broadcast((idf, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))))

        def scorer() -> Scorer:
            def score(batch: pa.RecordBatch, choice: Callable | None) -> Scored:
                for ids, wanted, posted in zip(*batch.columns):
                    sizes, each, codes, tfs = counts(posted)
                    owners = np.repeat(np.arange(len(sizes)), each)
                    if choice is not None:
                        some = choice(ids.values)[owners]
                        if not some.any():
                            continue
                        owners, codes, tfs = owners[some], codes[some], tfs[some]
                    yield ids.values, np.frombuffer(wanted.as_py(), bool), *S._pair_scores(sizes, owners, codes, tfs, mean, weights.value, n_queries, k, b)

            return score

        return Prepared(rows, query_ids, scorer)

    named = docs.withColumns({"id": F.col(id_col), "value": F.col(text_col)})
    return Scoring(named, lambda: S.document_bm25(docs, id_col, text_col, terms, kind, k, b), prepare, terms.schema["query_id"].dataType, of_nodes)


def vector_scoring(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, least: float | None = None) -> Scoring:
    """``search.cosine_scores``, with the queries' vectors on every worker."""

    def prepare(flagged: DataFrame) -> Prepared | None:
        many_tasks(vectors.sparkSession)
        asked = queries.select("query_id", "vector").limit(MOST_CANDIDATES // LEAST_CANDIDATES + 1).toArrow()  # bounded
        query_ids = asked.column("query_id").to_pylist()
        if len(query_ids) > MOST_CANDIDATES // LEAST_CANDIDATES or asked.nbytes > MOST_VECTOR_BYTES or None in query_ids or len(set(query_ids)) < len(query_ids):
            return None
        if not S._distinct_ids(vectors, id_col):
            return None
        needles = list(V.matrices(asked.column("vector").combine_chunks()))
        shared = vectors.sparkSession.sparkContext.broadcast(needles)

        def scorer() -> Scorer:
            def score(batch: pa.RecordBatch, choice: Callable | None) -> Scored:
                ids, wanted = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                chosen = None if choice is None else choice(ids)
                for dim, at, matrix in V.matrices(batch.column(1)):
                    if chosen is not None:
                        at, matrix = at[chosen[at]], matrix[chosen[at]]
                    for other, rows, needle in shared.value:
                        if other == dim and len(at):
                            i, j, found = V.block_scores(matrix, needle, least)
                            yield ids, wanted, at[i], rows[j], found

            return score

        return Prepared(spread(flagged).persist(StorageLevel.DISK_ONLY), query_ids, scorer)

    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("value"))
    return Scoring(named, lambda: S.cosine_scores(vectors, queries, id_col, vector_col, least), prepare, queries.schema["query_id"].dataType)


def _sortable(ids: pa.Array) -> np.ndarray:
    """Ids in an order like Spark's; nulls stand for some value."""
    if pa.types.is_integer(ids.type):
        return ids.fill_null(0).to_numpy(zero_copy_only=False)
    return ids.cast(pa.binary()).fill_null(b"").to_numpy(zero_copy_only=False)


def _codes(ids: pa.Array, pool: np.ndarray) -> np.ndarray:
    """Where ids stand among those of ``pool``: odd for its own, even between them, nulls before all."""
    values = _sortable(ids)
    at = np.searchsorted(pool, values)
    code = 2 * at + (pool[np.minimum(at, len(pool) - 1)] == values).astype(np.int64)
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, code) if ids.null_count else code


@dataclass
class _Ranking:
    """A prepared scoring whose queries have the numbers that all rankings share."""

    prepared: Prepared
    weight: float
    threshold: float | None
    numbers: np.ndarray
    id_type: T.DataType

    def _scored(self) -> Callable[[Iterator[pa.RecordBatch], Callable | None], Scored]:
        make, threshold, numbers = self.prepared.scorer, self.threshold, self.numbers

        def run(batches: Iterator[pa.RecordBatch], choice: Callable | None = None) -> Scored:
            score = make()
            for batch in batches:
                for ids, wanted, row, query, found in score(batch, choice):
                    if threshold is not None:
                        keep = found >= threshold
                        row, query, found = row[keep], query[keep], found[keep]
                    yield ids, wanted, row, numbers[query], found

        return run

    def _pairs(self, run: Callable) -> DataFrame:
        return self.prepared.rows.mapInArrow(run, f"query int, id {self.id_type.simpleString()}, score double")

    def best(self, most: int, only: np.ndarray) -> pa.Table:
        """(query, id, score): the best ``most`` wanted rows of the queries in ``only``."""
        scored, room = self._scored(), max(2 * most * int(only.sum()), S.PAIR_ROWS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floor = np.where(only, -np.inf, np.inf)
            held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

            def cut() -> tuple[pa.Array, np.ndarray, np.ndarray]:
                ids, query, found = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                kept = S._best(ids, np.arange(len(ids)), query, found, most)
                return ids.take(pa.array(kept)), query[kept], found[kept]

            n = 0
            for ids, wanted, row, query, found in scored(batches):
                keep = np.flatnonzero(wanted[row] & (found >= floor[query]))
                if len(keep):
                    held.append((ids.take(pa.array(row[keep])), query[keep], found[keep]))
                    n += len(keep)
                if n > room:
                    held[:] = [cut()]
                    _, query, found = held[0]
                    n = len(query)
                    last = np.flatnonzero(np.bincount(query, minlength=len(only)) >= most)
                    floor[last] = found[np.searchsorted(query, last, "right") - 1]
            if held:
                ids, query, found = cut()
                for p in range(0, len(query), S.PAIR_ROWS):
                    part = slice(p, p + S.PAIR_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(query[part], pa.int32()), ids[part], pa.array(found[part])], names=["query", "id", "score"])

        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
        return self._pairs(run).withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= most).drop("_at").toArrow()

    def scores(self, pool: np.ndarray, keys: np.ndarray) -> pa.Table:
        """(query, id, score) of the pairs ``keys``: query * len(pool) + place of the id."""
        scored, shared = self._scored(), self.prepared.rows.sparkSession.sparkContext.broadcast((pool[np.unique(keys % len(pool))], pool, keys))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some, pool, keys = shared.value
            for ids, _, row, query, found in scored(batches, lambda ids: _codes(ids, some) % 2 == 1):
                key = query * len(pool) + _codes(ids, pool)[row] // 2
                keep = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array(query[keep], pa.int32()), ids.take(pa.array(row[keep])), pa.array(found[keep])], names=["query", "id", "score"])

        return self._pairs(run).toArrow()

    def ranks(self, pool: np.ndarray, query: np.ndarray, place: np.ndarray, score: np.ndarray, n_queries: int) -> np.ndarray:
        """Ranks among all rows of candidates that are sorted by query, descending score and place."""
        begin = np.searchsorted(query, np.arange(n_queries + 1))
        new = np.concatenate([[True], (np.diff(query) != 0) | (np.diff(score) != 0)])
        first = np.maximum.accumulate(np.where(new, np.arange(len(query)), 0)) - begin[query]  # of equal scores
        base = 2 * len(pool) + 2
        context = self.prepared.rows.sparkSession.sparkContext
        shared = context.broadcast((pool, begin, -score, first, first * base + 2 * place + 1))
        scored = self._scored()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pool, begin, falling, first, keys = shared.value
            ahead = np.zeros(begin[-1], np.int64)
            for ids, _, row, query, found in scored(batches):
                code = _codes(ids, pool)
                order = np.argsort(query.astype(np.int32), kind="stable")
                bounds = np.searchsorted(query[order], np.arange(n_queries + 1))
                for q in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(begin) > 0)):
                    rows, mine = order[bounds[q] : bounds[q + 1]], slice(begin[q], begin[q + 1])
                    value, candidates = -found[rows], falling[mine]
                    at = np.searchsorted(candidates, value, "right")  # the first candidate that the row is ahead of
                    tied = np.flatnonzero((at > 0) & (candidates[at - 1] == value))
                    if len(tied):
                        at[tied] = np.searchsorted(keys[mine], first[mine][at[tied] - 1] * base + code[row[rows[tied]]], "right")
                    ahead[mine] += np.bincount(at, minlength=len(candidates) + 1)[:-1]
            for q in np.flatnonzero(np.diff(begin)):
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([ahead[begin[q] : begin[q + 1]].tobytes()], pa.binary())], names=["query", "ahead"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for q, ahead in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    counts = np.frombuffer(ahead, np.int64)
                    sums[q] = sums[q] + counts if q in sums else counts
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["query", "ahead"])

        spec = "query int, ahead binary"
        out = np.zeros(len(query), np.int64)
        found = self.prepared.rows.mapInArrow(run, spec).repartition("query").mapInArrow(total, spec).toArrow()
        for q, ahead in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
            out[begin[q] : begin[q + 1]] = np.cumsum(np.frombuffer(ahead, np.int64)) + 1
        return out


def _columns(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    ids = table.column("id").combine_chunks()
    return table.column("query").to_numpy().astype(np.int64), ids, table.column("score").to_numpy()


def _round(rankings: list[_Ranking], only: np.ndarray, most: int, k: int, need: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray, pa.Array, list[np.ndarray]]:
    """Which queries are settled; query, id and ranks (0: none) of their rows that may be among the first ``need``."""
    n_queries = len(only)
    own = [_columns(r.best(most, only)) for r in rankings]
    ids = pa.concat_arrays([ids for _, ids, _ in own])
    pool, at = np.unique(_sortable(ids), return_index=True)
    if not len(pool):
        return only, np.zeros(0, np.int64), ids, [np.zeros(0, np.int64) for _ in rankings]
    pool_ids, size = ids.take(pa.array(at)), len(pool)
    own_keys = [query * size + _codes(ids, pool) // 2 for query, ids, _ in own]
    keys = np.unique(np.concatenate(own_keys))
    query = keys // size
    fused, unseen, ranks = np.zeros(len(keys)), np.zeros(n_queries), []
    for r, mine, (_, _, score) in zip(rankings, own_keys, own):
        others = np.setdiff1d(keys, mine)
        every = mine
        if len(others):
            asking, ids, more = _columns(r.scores(pool, others))
            every, score = np.concatenate([mine, asking * size + _codes(ids, pool) // 2]), np.concatenate([score, more])
        order = np.lexsort((every % size, -score, every // size))
        every, score = every[order], score[order]
        rank = np.zeros(len(keys), np.int64)
        if len(every):
            rank[np.searchsorted(keys, every)] = r.ranks(pool, every // size, every % size, score, n_queries)
        part = np.where(rank > 0, r.weight / (k + np.maximum(rank, 1)), 0.0)
        fused += part
        last = np.zeros(n_queries, np.int64)
        np.maximum.at(last, mine // size, rank[np.searchsorted(keys, mine)])
        full = np.bincount(mine // size, minlength=n_queries) >= most
        unseen += np.where(full, r.weight / (k + last + 1), 0.0)
        ranks.append(rank)
    order = np.lexsort((-fused, query))
    begin = np.searchsorted(query, np.arange(n_queries + 1))
    enough = np.diff(begin) >= need
    worst = np.full(n_queries, -np.inf)  # no row of the result has less
    worst[enough] = low * fused[order][begin[:-1][enough] + need - 1] - ROUNDING
    settled = only & ((unseen == 0) | (high * unseen < worst))
    kept = np.flatnonzero(settled[query] & (high * fused >= worst[query]))
    return settled, query[kept], pool_ids.take(pa.array(keys[kept] % size)), [rank[kept] for rank in ranks]


def best_ranks(nodes: DataFrame, scorings: list[tuple[Scoring, float, float | None]], *, filters: Column | None, boost: Column, k: int, need: int) -> list[DataFrame] | None:
    """(query_id, id, rank) of each scoring, for the rows that may be among a query's first ``need``.

    ``scorings`` are with their weights and thresholds, ``boost`` is what a fused score is
    multiplied with.  None where the bounds don't hold, or ids repeat: rank it whole then.
    """
    id_type, spark = nodes.schema["id"].dataType, nodes.sparkSession
    if not isinstance(id_type, (T.IntegralType, T.StringType)) or any(s.rows.schema["id"].dataType != id_type for s, _, _ in scorings):
        return None
    found = nodes if filters is None else nodes.filter(filters)
    low, high = found.agg(F.min(boost), F.max(boost)).first()
    low, high = (1.0, 1.0) if low is None else (low, high)
    if need < 1 or k < 0 or low < 0 or not math.isfinite(high) or any(w < 0 for _, w, _ in scorings):
        return None
    prepared: list[Prepared] = []
    try:
        for s, _, _ in scorings:
            if s.of_nodes:
                rows = s.rows.select("id", "value", (F.lit(True) if filters is None else F.coalesce(filters, F.lit(False))).alias("wanted"))
            else:
                wanted = found.select("id").distinct().withColumn("wanted", F.lit(True))
                rows = s.rows.select("id", "value").join(wanted, "id", "left").select("id", "value", F.coalesce("wanted", F.lit(False)).alias("wanted"))
            one = s.prepare(rows)
            if one is None:
                return None
            prepared.append(one)
        query_ids = sorted(set().union(*(p.query_ids for p in prepared)))
        number = {q: at for at, q in enumerate(query_ids)}
        rankings = [_Ranking(p, w, t, np.array([number[q] for q in p.query_ids], np.int64), id_type) for p, (_, w, t) in zip(prepared, scorings)]
        only, most = np.ones(len(query_ids), bool), max(LEAST_CANDIDATES, math.ceil(2 * min(high / low if low else 8.0, 8.0) * (k + need)))
        rounds = []
        while only.any() and int(only.sum()) * most <= MOST_CANDIDATES:
            settled, *rows = _round(rankings, only, most, k, need, low, high)
            rounds.append(rows)
            only, most = only & ~settled, most * GROWTH
    finally:
        for p in prepared:
            p.rows.unpersist()
    key_type = to_arrow_type(scorings[0][0].query_type)
    left = spark.createDataFrame(pa.table({"query_id": pa.array([query_ids[q] for q in np.flatnonzero(only)], key_type)})) if only.any() else None
    out = []
    for at, (s, _, threshold) in enumerate(scorings):
        keys, ids, ranks = [], [], []
        for query, id_, rank in rounds:
            has = pa.array(np.flatnonzero(rank[at]))
            keys.append(pa.array(query_ids, key_type).take(pa.array(query).take(has)))
            ids.append(id_.take(has))
            ranks.append(pa.array(rank[at]).take(has))
        parts = [spark.createDataFrame(pa.table({"query_id": pa.concat_arrays(keys), "id": pa.concat_arrays(ids), "rank": pa.concat_arrays(ranks).cast(pa.int32())}))] if rounds else []
        if left is not None:
            parts.append(S.ranked(s.whole().join(F.broadcast(left), "query_id", "left_semi"), threshold).select("query_id", "id", "rank"))
        out.append(parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1]))
    return out
