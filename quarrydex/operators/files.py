"""File search: fuzzy completion, glob listing, trigram hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import text as X


def search_view(files: DataFrame) -> DataFrame:
    """``files`` (id, repo_id, path) with the lower-case path and base name."""
    low = F.lower("path")
    return files.withColumn("path_lc", low).withColumn("base_lc", X.basename(low))


def trigram_index(files: DataFrame) -> DataFrame:
    """(id, trigram): distinct pieces of each lower-case path."""
    return search_view(files).select("id", F.explode(X.trigrams(F.col("path_lc"))).alias("trigram"))


def trigram_hits(files: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, hits): how many of a needle's distinct trigrams a path holds."""
    wanted = queries.select("query_id", F.explode(X.trigrams(F.lower("needle"))).alias("trigram"))
    return trigram_index(files).join(wanted, "trigram").groupBy("query_id", "id").agg(F.count("*").alias("hits"))


def complete(files: DataFrame, queries: DataFrame, *, repos: list[str] | None = None, boost_repo: str | None = None, boost: float = 1.2, limit: int = 5) -> DataFrame:
    """(query_id, position, id, path, score): files whose path has the needle as a subsequence.

    Needles under three characters find nothing; an empty list of repositories finds
    nothing and none at all means every repository.  Trigrams only add to the score.
    """
    asked = queries.filter(F.length("needle") >= 3).select("query_id", P.subsequence_regex(F.col("needle")).alias("_re"), F.lower("needle").alias("_needle"))
    found = search_view(files)
    if repos is not None:
        found = found.filter(F.col("repo_id").isin(repos)) if repos else found.filter(F.lit(False))
    hits = F.size(F.array_intersect(X.trigrams(F.col("path_lc")), X.trigrams(F.col("_needle"))))
    rows = found.join(asked, F.expr("path_lc RLIKE _re")).withColumn("_hits", hits)
    score = P.filename_score(F.expr("base_lc RLIKE _re"), F.lit(True), F.col("_hits"), F.col("path_lc"))
    if boost_repo is not None and boost != 1.0:
        score = score * F.when(F.col("repo_id") == boost_repo, boost).otherwise(1.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "id")
    rows = rows.withColumn("score", F.round(score, 6)).withColumn("position", F.row_number().over(order))
    return rows.filter(F.col("position") <= limit).select("query_id", "position", "id", "path", "score")


def glob_list(files: DataFrame, pattern: str, *, repos: list[str] | None = None, first_repo: str | None = None, limit: int | None = 50) -> DataFrame:
    """Files whose path matches a glob, a given repository's first, then by path."""
    if repos is not None and not repos:
        return files.filter(F.lit(False))
    found = files.filter(P.glob_match(F.col("path"), pattern))
    if repos is not None:
        found = found.filter(F.col("repo_id").isin(repos))
    first = [] if first_repo is None else [F.when(F.col("repo_id") == first_repo, 0).otherwise(1).asc()]
    ordered = found.orderBy(*first, F.asc("path"), F.asc("id"))
    return ordered if limit is None else ordered.limit(limit)


def suffix_stats(files: DataFrame, measure: str) -> DataFrame:
    """(suffix, n, total, average) of a measure by file extension."""
    return files.groupBy(P.suffix(F.col("path")).alias("suffix")).agg(
        F.count("*").alias("n"), F.sum(measure).alias("total"), F.round(F.avg(measure), 6).alias("average")
    )
