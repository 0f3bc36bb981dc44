"""A text index that is a snapshot: searches see what the last refresh saw."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.store import Store


class TextIndex:
    """Postings and corpus statistics of the nodes' needles, kept as Parquet tables.

    Postings are clustered by term, so that a search for a few terms reads few row groups.
    A refresh makes a new index and then puts it in place at once, so searches that run
    meanwhile see the old one.
    """

    NAME = "text_index"

    def __init__(self, store: Store):
        self.store = store

    def _at(self) -> str | None:
        _, found = self.store._manifest(self.NAME)
        return f"{self.store.path}/{self.NAME}/{found['index'][0]}" if found else None

    def refresh(self) -> None:
        """Build the index anew from the current nodes."""
        version, _ = self.store._manifest(self.NAME)
        name = f"s-{uuid.uuid4().hex[:12]}"
        at = f"{self.store.path}/{self.NAME}/{name}"
        tokens = S.tokenised(self.store.read("nodes"), "id", "fts_needle", "noop")
        S.postings(tokens).repartitionByRange("term").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
        S.corpus_stats(tokens).write.parquet(f"{at}/stats")
        self.store._commit(self.NAME, version, {"index": [name]})
        self.store.vacuum(self.NAME)

    def valid(self) -> bool:
        """Whether there is an index to search."""
        at = self._at()
        if at is None:
            return False
        return all(self.store._names(f"{at}/{part}") for part in ("postings", "stats"))

    def scores(self, queries: DataFrame, kind: str = "code", k: float = S.K1, b: float = S.B) -> DataFrame:
        """(query_id, id, score) by BM25; an index that isn't there, or has lost files, is built first."""
        if not self.valid():
            self.refresh()
        read, at = self.store.spark.read, self._at()
        terms = S.needle_terms(queries, kind=kind)
        found = read.parquet(f"{at}/postings").join(terms.select("term").distinct(), "term", "left_semi")
        return S.score_postings(found, terms, read.parquet(f"{at}/stats"), k, b)

    def validate(self) -> DataFrame:
        """(id) of nodes that the index doesn't know, or knows though they are gone or changed."""
        now = S.tokenised(self.store.read("nodes"), "id", "fts_needle", "noop").select("id", F.size("terms").alias("len"))
        at = self._at()
        if at is None:
            return now.filter("len > 0").select("id")
        known = self.store.spark.read.parquet(f"{at}/postings").select("id", "len").distinct()
        both = now.filter("len > 0").join(known.withColumnRenamed("len", "_len"), "id", "full_outer")
        return both.filter("len IS NULL OR _len IS NULL OR len <> _len").select("id")
