"""Ranked search: postings and corpus statistics, BM25, cosine ranking, rank fusion.

Every function takes a DataFrame of queries, so windows are partitioned by query and
many needles run in one job.  BM25 reads and tokenises each document once: postings are
cut to the needles' terms before they are shuffled, a marker among them carries each
document's length, and statistics, frequencies and scores share that one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from ..schema import SearchSettings
from ..session import many_tasks, spread

if TYPE_CHECKING:
    from .fusion import Scoring

K1, B = 1.2, 0.75


def needle_terms(queries: DataFrame, needle: str = "needle", kind: str = "code") -> DataFrame:
    """(query_id, term): distinct lower-case terms of each needle."""
    terms = F.array_distinct(F.transform(X.tokens(F.col(needle), kind), lambda w: F.lower(w)))
    return queries.select("query_id", F.explode(terms).alias("term"))


def tokenised(docs: DataFrame, id_col: str, text_col: str, kind: str = "code") -> DataFrame:
    """(id, terms): the lower-case tokens of each document."""
    texts = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")))
    return texts.select(F.col("_id").alias("id"), F.transform(X.tokens(F.col("_text"), kind), lambda w: F.lower(w)).alias("terms"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length in tokens."""
    return tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("avg_len"))


def postings(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, len), for all terms or only those of ``terms``."""
    each = tokens.select("id", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term", "left_semi")
    return each.groupBy("id", "term", "len").agg(F.count("*").alias("tf"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """(term, df): in how many documents a term stands."""
    return tokens.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


#: Scored pairs that a worker sends at once.
PAIR_ROWS = 100_000
#: Documents whose terms, and (document, query) scores, that a worker holds at once.
POSTED_DOCUMENTS, SCORED_PAIRS = 1000, 2_000_000
#: Slices of a score unit that ``ranked`` sorts apart.
SLICES = 8
#: (query, term) rows that are sent to every executor; more are joined by shuffles.
BROADCAST_TERMS = 200_000
#: The term that stands once for every document in marked postings; no tokenizer gives it.
MARKER = ""


def marked_postings(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``postings`` cut to ``terms``, and a row of ``MARKER`` for each document, with its length.

    They come partitioned by document, so counting and later sums by document need no other shuffle.
    """
    wanted = terms.select("term").unionAll(terms.sparkSession.range(1).select(F.lit(MARKER).alias("term"))).distinct()
    each = tokens.select("id", F.size("terms").alias("len"), F.explode(F.concat("terms", F.array(F.lit(MARKER)))).alias("term"))
    return each.join(wanted, "term", "left_semi").repartition("id").groupBy("id", "term", "len").agg(F.count("*").alias("tf"))


def _small(terms: DataFrame) -> bool:
    return terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def bm25(tokens: DataFrame, terms: DataFrame, k: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score): documents with at least one of a needle's terms.

    idf = ln((N - df + 0.5) / (df + 0.5) + 1), a term adds
    idf * tf * (k + 1) / (tf + k * (1 - b + b * len / mean length)).
    """
    found = marked_postings(tokens, terms)
    # conditions in the sums, not filters: these would be pushed below the exchange that the plans share
    mark = F.col("term") == MARKER
    n = F.sum(F.when(mark, F.col("tf")).otherwise(0))
    stats = found.agg(n.alias("n_docs"), (F.sum(F.when(mark, F.col("len") * F.col("tf")).otherwise(0)) / n).alias("avg_len"))
    return score_postings(found, terms, stats, k, b)


def score_postings(found: DataFrame, terms: DataFrame, stats: DataFrame, k: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of postings cut to the needles' terms."""
    df = found.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    small = F.broadcast if _small(terms) else lambda x: x
    weighed = df.join(small(terms), "term").crossJoin(F.broadcast(stats))  # statistics: one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = weighed.select("query_id", "term", idf.alias("idf"), "avg_len")
    tf = F.col("tf")
    part = F.col("idf") * tf * (k + 1) / (tf + k * (1 - b + b * F.col("len") / F.col("avg_len")))
    return found.join(small(weighed), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def _distinct_ids(docs: DataFrame, id_col: str) -> bool:
    return docs.groupBy(id_col).count().filter("count > 1").isEmpty()


def document_postings(docs: DataFrame, id_col: str, text_col: str, kind: str = "code") -> DataFrame:
    """``postings`` of all terms, counted document by document on the workers.

    Documents of equal id and length are counted together, which takes the shuffles of
    ``postings``; so do tokens that aren't ASCII words.
    """
    if kind == "noop" or not _distinct_ids(docs, id_col):
        return postings(tokenised(docs, id_col, text_col, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = X.term_counter(kind)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, POSTED_DOCUMENTS):
                rows, terms, sizes, tfs = [], [], [], []
                for k, text in enumerate(texts.slice(at, POSTED_DOCUMENTS).to_pylist(), at):
                    size, found = count(text)
                    rows += [k] * len(found)
                    sizes += [size] * len(found)
                    terms += found
                    tfs += found.values()
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(tfs, pa.int64())], names=["id", "term", "len", "tf"])

    key = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"id {key}, term string, len int, tf bigint")


def _asked_terms(terms: DataFrame) -> tuple[dict[bytes, int], list, np.ndarray] | None:
    """Numbers of the needles' terms, ids of their queries, and (term, query) pairs in order; none of too many."""
    asked = terms.filter("term IS NOT NULL").limit(BROADCAST_TERMS + 1).collect()  # bounded
    if len(asked) > BROADCAST_TERMS:
        return None
    words = {t: at for at, t in enumerate(sorted({r["term"].encode() for r in asked}))}
    query_ids = sorted({r["query_id"] for r in asked})
    place = {q: at for at, q in enumerate(query_ids)}
    return words, query_ids, np.array(sorted((words[r["term"].encode()], place[r["query_id"]]) for r in asked), np.int64).reshape(-1, 2)


def _counted(texts: pa.Array, count) -> tuple[np.ndarray, ...]:
    """Lengths of documents; document, term and frequency of their wanted terms."""
    sizes, owners, codes, tfs = [], [], [], []
    for at, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        size, found = count(text)
        sizes.append(size)
        owners += [at] * len(found)
        codes += found
        tfs += found.values()
    return tuple(np.array(x, np.int64) for x in (sizes, owners, codes, tfs))


def _corpus_weights(tallies: DataFrame, n_words: int) -> tuple[float, np.ndarray]:
    """Mean length and each term's idf, from (code, n): documents that have a term, all under -2, their length under -1."""
    sums = {r["code"]: r["n"] for r in tallies.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    n_docs, df = sums.get(-2, 0), np.array([sums.get(c, 0) for c in range(n_words)], np.float64)
    return sums.get(-1, 0) / n_docs if n_docs else 0.0, np.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def _pair_scores(sizes, owners, codes, tfs, mean: float, weights: tuple[np.ndarray, ...], n_queries: int, k: float, b: float) -> tuple[np.ndarray, ...]:
    """(document, query, score) of counted documents."""
    idf, of_term, begin = weights
    part = idf[codes] * tfs * (k + 1) / (tfs + k * (1 - b + b * sizes[owners] / mean)) if len(codes) else np.zeros(0)
    times = np.diff(begin)[codes]
    entry = np.repeat(begin[codes] - np.cumsum(times) + times, times) + np.arange(times.sum())
    cells = np.repeat(owners, times) * n_queries + of_term[entry]
    score = np.bincount(cells, np.repeat(part, times), minlength=len(sizes) * n_queries)
    hit = np.flatnonzero(score)  # every part is over zero
    return hit // n_queries, hit % n_queries, np.floor(score[hit] * 1e6 + 0.5) / 1e6


def document_bm25(
    docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, kind: str = "code", k: float = K1, b: float = B, least: float | None = None, most: int | None = None
) -> DataFrame:
    """``bm25`` of texts, scored document by document on the workers, without a shuffle.

    A first pass counts lengths and document frequencies of the needles' terms, a second
    scores.  With ``least`` and ``most``, only what ``ranked`` with the same can take
    leaves a worker.  Too many needles, ids that repeat (their texts count as one if they
    have the same length) and tokens that aren't ASCII words take the plan of ``bm25``.
    """
    many_tasks(docs.sparkSession)
    asked = _asked_terms(terms)
    if kind == "noop" or asked is None or not _distinct_ids(docs, id_col):
        return bm25(tokenised(docs, id_col, text_col, kind), terms, k, b)
    words, query_ids, pairs = asked
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(words)
    texts = spread(docs.select(id_col, text_col))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = X.term_counter(kind, shared.value)
        df, n, length = np.zeros(len(shared.value), np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, POSTED_DOCUMENTS):
                sizes, _, codes, _ = _counted(batch.slice(at, POSTED_DOCUMENTS).column(1), count)
                df += np.bincount(codes, minlength=len(df))
                n, length = n + len(sizes), length + int(sizes.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, length], df[some]]))], names=["code", "n"])

    mean, idf = _corpus_weights(texts.mapInArrow(tally, "code bigint, n bigint"), len(words))
    weights = context.broadcast((idf, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))))
    at_once = max(1, min(POSTED_DOCUMENTS, SCORED_PAIRS // max(1, len(query_ids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = X.term_counter(kind, shared.value)
        keys = pa.array(query_ids, key_type)
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                some = batch.slice(start, at_once)
                doc, asking, score = _pair_scores(*_counted(some.column(1), count), mean, weights.value, len(query_ids), k, b)
                if least is not None:
                    keep = score >= least
                    doc, asking, score = doc[keep], asking[keep], score[keep]
                if most is not None and len(doc) > most:
                    keep = _best(some.column(0), doc, asking, score, most)
                    doc, asking, score = doc[keep], asking[keep], score[keep]
                for p in range(0, len(doc), PAIR_ROWS):
                    cut = slice(p, p + PAIR_ROWS)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(asking[cut])), some.column(0).take(pa.array(doc[cut])), pa.array(score[cut])], names=["query_id", "id", "score"])

    key_type = to_arrow_type(terms.schema["query_id"].dataType)
    kinds = [terms.schema["query_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()]
    return texts.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def _best(ids: pa.Array, row: np.ndarray, group: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of each group's best ``most`` scores, ties by id."""
    place = np.empty(len(ids), np.int64)
    place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    order = np.lexsort((place[row], -score, group))
    return order[np.arange(len(order)) - np.searchsorted(group[order], group[order]) < most]


def cosine_scores(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, least: float | None = None, most: int | None = None) -> DataFrame:
    """(query_id, id, score): every vector against a stated set of query vectors of its dimension.

    Blocks of vectors meet blocks of queries, and a pair of blocks is one product of
    matrices.  With ``least`` and ``most`` a pair gives only what ``ranked`` with the same
    can take: scores from ``least`` on, and of each query the best ``most``, ties by id.
    Null and zero vectors have no score, nor have those with null or non-finite components.
    """
    kinds = [queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()]
    stored = V.blocks(spread(vectors.select(id_col, vector_col)), id_col, vector_col, "v_")
    asked = V.blocks(queries.select("query_id", "vector").hint("rebalance"), "query_id", "vector", "q_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, ids, query_ids = batch.column("v_dim")[k].as_py(), batch.column("v_ids")[k].values, batch.column("q_ids")[k].values
                if dim != batch.column("q_dim")[k].as_py():
                    continue
                a, b = (np.frombuffer(batch.column(c)[k].as_py()).reshape(-1, dim) for c in ("v_values", "q_values"))
                i, j, score = V.block_scores(a, b, least, most)
                if most is not None and len(i) > most:
                    order = _best(ids, i, j, score, most)
                    i, j, score = i[order], j[order], score[order]
                for p in range(0, len(i), PAIR_ROWS):
                    part = slice(p, p + PAIR_ROWS)
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(j[part])), ids.take(pa.array(i[part])), pa.array(score[part])], names=["query_id", "id", "score"])

    # no join on dimensions: a shuffle by them would put everything into one task
    return stored.crossJoin(asked).mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def ranked(scores: DataFrame, threshold: float | None = None, most: int | None = None, sliced_ranks: bool = False) -> DataFrame:
    """``scores`` over a threshold with their rank in each query; ties go by id.

    With ``most``, tasks keep their best rows only.  Without, one task sorts a query's
    rows, on disk if need be.  ``sliced_ranks`` is for queries that match more than that
    allows: they are ranked in slices of their scores, whose ranks follow those of the
    slices above, which reads the scores twice.
    """
    kept = scores.filter("score IS NOT NULL") if threshold is None else scores.filter(F.col("score") >= threshold)
    best_first = [F.desc("score"), F.asc("id")]
    if most is not None or not sliced_ranks:
        out = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first)))
        return out if most is None else out.filter(F.col("rank") <= most)
    sliced = kept.withColumn("_slice", F.floor(F.col("score") * SLICES))
    within = sliced.withColumn("_in", F.row_number().over(Window.partitionBy("query_id", "_slice").orderBy(*best_first)))
    sizes = within.groupBy("query_id", "_slice").agg(F.max("_in").alias("_n"))
    above = sizes.select("query_id", "_slice", (F.sum("_n").over(Window.partitionBy("query_id").orderBy(F.desc("_slice"))) - F.col("_n")).alias("_above"))
    out = within.join(above, ["query_id", "_slice"])
    return out.select(*scores.columns, (F.col("_in") + F.col("_above")).cast("int").alias("rank"))


def fuse(rankings: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: (query_id, id, rrf), the sum of weight / (k + rank)."""
    parts = [r.select("query_id", "id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part")) for r, w in rankings]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionAll(p)
    return merged.groupBy("query_id", "id").agg(F.sum("part").alias("rrf"))


def kind_boost(kind: Column, boosts: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, factor in boosts.items():
        out = F.when(kind == name, F.lit(float(factor))).otherwise(out)
    return out


def hybrid_search(
    nodes: DataFrame,
    queries: DataFrame,
    *,
    text_scores: DataFrame | Scoring | None = None,
    vector_scores: DataFrame | Scoring | None = None,
    settings: SearchSettings | None = None,
    boost_repo: str | None = None,
    filters: Column | None = None,
    limit: int | None = 20,
    offset: int = 0,
) -> DataFrame:
    """Nodes ranked by fused scores: (query_id, position, score, *node columns).

    Ranks are taken over all nodes, whatever their repository or kind; ``filters``
    apply to the fused rows only.  ``nodes`` has id, name, repo_id and, for boosts,
    search_boost.  With neither ranker, nodes come in name order, those of the
    boosted repository first.  With a limit, scores given as ``Scoring`` are ranked where
    it can matter only (``fusion.best_ranks``).
    """
    from .fusion import Scoring, best_ranks  # which reckons with the steps above

    s = settings or SearchSettings()
    here = F.lit(0) if boost_repo is None else F.when(F.col("repo_id") == boost_repo, 0).otherwise(1)
    given = [(vector_scores, s.similarity_threshold, s.vector_weight), (text_scores, s.bm25_threshold, s.text_weight)]
    given = [g for g in given if g[0] is not None]
    if given:
        boost = F.coalesce(F.col("search_boost").cast("double"), F.lit(1.0))
        own = F.when(F.col("repo_id") == boost_repo, s.repo_boost).otherwise(1.0) if boost_repo is not None and s.repo_boost != 1.0 else None
        ranks = None
        if limit is not None and all(isinstance(scores, Scoring) for scores, _, _ in given):
            ranks = best_ranks(
                nodes, [(scores, weight, threshold) for scores, threshold, weight in given],
                filters=filters, boost=boost if own is None else boost * own, k=s.rrf_k, need=offset + limit,
            )
        if ranks is None:
            whole = [scores.whole() if isinstance(scores, Scoring) else scores for scores, _, _ in given]
            ranks = [ranked(scores, threshold, sliced_ranks=s.sliced_ranks) for scores, (_, threshold, _) in zip(whole, given)]
        fused = fuse([(r, weight) for r, (_, _, weight) in zip(ranks, given)], s.rrf_k)
        rows = nodes.join(fused, "id")
        score = F.col("rrf") * boost
        if own is not None:
            score = score * own
        rows = rows.withColumn("score", F.round(score, 9)).drop("rrf")
        order = [F.desc("score"), F.asc_nulls_last("name"), F.asc("id")]
    else:
        rows = nodes.crossJoin(queries.select("query_id")).withColumn("score", F.lit(None).cast("double"))
        order = [here.asc(), F.asc_nulls_last("name"), F.asc("id")]
    if filters is not None:
        rows = rows.filter(filters)
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    if limit is not None:
        rows = rows.filter(F.col("position") <= offset + limit)
    return rows.filter(F.col("position") > offset)
