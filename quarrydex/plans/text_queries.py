"""Queries over texts: tokens, needles, BM25, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import fusion
from ..operators import search as S
from ..schema import SearchSettings
from .registry import code_sql, query, terms_sql, words_sql

STOP = ["the", "and", "der", "de", "la"]


@query(f"SELECT doc_id, len({words_sql('text')})::INT AS n, md5(array_to_string({words_sql('text')}, ' ')) AS digest FROM documents")
def word_tokens(t):
    w = X.word_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


@query(f"SELECT page_id AS id, array_to_string({code_sql('url')}, ' ') AS tokens FROM pages UNION ALL SELECT p_partkey, array_to_string({code_sql('p_brand')}, ' ') FROM part")
def code_tokens(t):
    a = t("pages").select(F.col("page_id").alias("id"), F.array_join(X.code_tokens(F.col("url")), " ").alias("tokens"))
    return a.unionAll(t("part").select("p_partkey", F.array_join(X.code_tokens(F.col("p_brand")), " ")))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::INT AS n FROM documents")
def noop_tokens(t):
    return t("documents").select("doc_id", F.size(X.noop_tokens(F.col("text"))).alias("n"))


@query(f"SELECT doc_id, len(list_filter({words_sql('text')}, lambda x: lower(x) NOT IN ({', '.join(repr(s) for s in STOP)})))::INT AS n FROM documents")
def stop_words(t):
    return t("documents").select("doc_id", F.size(X.without_stop_words(X.word_tokens(F.col("text")), STOP)).alias("n"))


@query(
    f"SELECT doc_id, length(n)::INT AS n_chars, md5(n) AS digest FROM (SELECT doc_id, array_to_string(list_concat(list_concat({code_sql('source')}, {code_sql('source')}, {code_sql('source')}), "
    f"list_concat({code_sql('p')}, {code_sql('p')}), {code_sql('text')}), ' ') AS n FROM (SELECT *, lang || '/' || doc_id || '.txt' AS p FROM documents))"
)
def search_needle(t):
    """A node's needle: its name three times, its path twice, its body once."""
    fields = {"name": F.col("source"), "file_path": F.concat_ws("/", "lang", F.concat(F.col("doc_id"), F.lit(".txt"))), "body": F.col("text")}
    n = X.search_needle(fields, SearchSettings().field_boosts)
    return t("documents").select("doc_id", F.length(n).alias("n_chars"), F.md5(n).alias("digest"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source || chr(10) || text ELSE text END AS text FROM documents")
def embedding_texts(t):
    docstring = F.when(F.col("lang") == "en", F.col("source"))
    return t("documents").select("doc_id", X.embedding_text(docstring, F.col("text")).alias("text"))


@query(f"SELECT count(*) AS n_docs, round(avg(len({terms_sql('text')})), 6) AS avg_len FROM documents")
def corpus_stats(t):
    return S.corpus_stats(S.tokenised(t("documents"), "doc_id", "text")).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY term")
def document_frequency(t):
    return S.document_frequency(S.tokenised(t("documents"), "doc_id", "text"))


@query(f"SELECT doc_id AS id, term, n AS len, count(*) AS tf FROM (SELECT doc_id, len(w)::INT AS n, unnest(w) AS term FROM (SELECT doc_id, {terms_sql('text')} AS w FROM documents)) GROUP BY ALL")
def postings(t):
    return S.document_postings(t("documents"), "doc_id", "text")


_BM25 = f"""
d AS (SELECT doc_id AS id, {terms_sql('text')} AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest({terms_sql('text')}) AS term FROM benchmark),
p AS (SELECT id, len(w) AS len, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score
    FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY query_id, id)"""


def _needles(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))


def _text_scores(t, **wanted):
    return S.document_bm25(t("documents"), "doc_id", "text", S.needle_terms(_needles(t)), **wanted)


@query(f"WITH {_BM25} SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM bm) WHERE rank <= 10")
def bm25_topk(t):
    """The ten best documents for every benchmark item."""
    return S.ranked(_text_scores(t, most=10), most=10)


@query(f"WITH {_BM25} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM bm WHERE score >= 20")
def bm25_threshold(t):
    return S.ranked(_text_scores(t, least=20.0), 20.0)


def _query_vectors(t):
    return t("embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_COS = """
cos AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
    FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)"""


def _vector_scores(t, **wanted):
    return S.cosine_scores(t("embeddings"), _query_vectors(t), "vec_id", "embedding", **wanted)


@query(f"WITH {_COS} SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM cos WHERE NOT isnan(score)) WHERE rank <= 10")
def cosine_topk(t):
    return S.ranked(_vector_scores(t, most=10), most=10)


@query(f"WITH {_COS} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM cos WHERE score >= 0.4 AND NOT isnan(score)")
def cosine_threshold(t):
    return S.ranked(_vector_scores(t, least=0.4), 0.4)


@query("SELECT label, list(x ORDER BY i) AS embedding FROM (SELECT label, i, round(avg(embedding[i]::DOUBLE), 9) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label")
def mean_pool(t):
    pooled = V.mean_pool(t("embeddings"), ["label"], "embedding")
    return pooled.select("label", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


@query(f"SELECT doc_id, count(*) AS n_windows, sum(least(512, len(w) - s))::BIGINT AS n_tokens FROM (SELECT doc_id, {words_sql('text')} AS w, unnest(range(0, greatest(len({words_sql('text')}), 1), 448)) AS s FROM documents) GROUP BY doc_id")
def token_windows(t):
    w = F.explode(V.token_windows(X.word_tokens(F.col("text")), 512)).alias("w")
    return t("documents").select("doc_id", w).groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.sum(F.size("w")).alias("n_tokens"))


# --- hybrid search: documents are nodes, their vectors those of equal id


def _nodes(t, *more):
    return t("documents").select(
        F.col("doc_id").alias("id"), F.concat("lang", F.lit("-"), F.length("text")).alias("name"), F.col("source").alias("repo_id"), F.col("lang").alias("kind"),
        F.when(F.col("lang") == "en", 2.0).when(F.col("lang") == "de", 1.5).otherwise(1.0).cast("float").alias("search_boost"), *more,
    )


_HYBRID = f"""
{_BM25},
pair AS (SELECT b.item_id AS query_id, v.embedding FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id),
cos AS (SELECT query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM embeddings v, pair p),
rv AS (SELECT query_id, id, 0.5::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)) AS part FROM cos WHERE score >= 0.4 AND NOT isnan(score)),
rt AS (SELECT query_id, id, 0.5::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)) AS part FROM bm),
nodes AS (SELECT doc_id AS id, lang || '-' || length(text) AS name, source AS repo_id, lang AS kind, CASE lang WHEN 'en' THEN 2.0 WHEN 'de' THEN 1.5 ELSE 1.0 END::DOUBLE AS boost FROM documents)"""


def _hybrid_sql(parts: str, score: str = "rrf * boost", where: str = "true", limit: int = 10, offset: int = 0) -> str:
    return f"""WITH {_HYBRID}, fused AS (SELECT query_id, id, sum(part) AS rrf FROM ({parts}) GROUP BY ALL),
    r AS (SELECT query_id, id, name, kind, round({score}, 9) AS score FROM fused JOIN nodes USING (id) WHERE {where})
    SELECT query_id, position, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name NULLS LAST, id)::INT AS position FROM r) WHERE position > {offset} AND position <= {offset + limit}"""


_BOTH = "FROM rv UNION ALL FROM rt"


def _search(t, text=True, vector=True, **options):
    queries = _needles(t)
    vectors = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).join(queries.select("query_id"), "query_id")
    found = S.hybrid_search(
        _nodes(t), queries,
        text_scores=fusion.text_scoring(_nodes(t, "text"), "id", "text", S.needle_terms(queries), of_nodes=True) if text else None,
        vector_scores=fusion.vector_scoring(t("embeddings"), vectors, "vec_id", "embedding", SearchSettings().similarity_threshold) if vector else None,
        **{"limit": 10} | options,
    )
    return found.select("query_id", "position", "id", "score")


@query(_hybrid_sql(_BOTH))
def rrf_hybrid(t):
    return _search(t)


@query(_hybrid_sql(_BOTH, "rrf * boost * CASE WHEN repo_id = 'src3' THEN 1.2 ELSE 1.0 END"))
def rrf_boosted(t):
    return _search(t, boost_repo="src3")


@query(_hybrid_sql(_BOTH, where="kind = 'de'"))
def rrf_filtered(t):
    """Ranks are over all nodes; the filter on kind comes after the fusion."""
    return _search(t, filters=F.col("kind") == "de")


@query(_hybrid_sql(_BOTH, offset=5, limit=5))
def rrf_page(t):
    return _search(t, limit=5, offset=5)


@query(_hybrid_sql("FROM rt"))
def rrf_text_only(t):
    return _search(t, vector=False)


@query(_hybrid_sql("FROM rv"))
def rrf_vector_only(t):
    return _search(t, text=False)


@query(f"WITH {_HYBRID} SELECT 0 AS query_id, position, id, NULL::DOUBLE AS score FROM (SELECT id, row_number() OVER (ORDER BY CASE WHEN repo_id = 'src3' THEN 0 ELSE 1 END, name NULLS LAST, id)::INT AS position FROM nodes) WHERE position <= 20")
def search_without_query(t):
    """No ranker: name order, the boosted repository first."""
    one = t("benchmark").select(F.lit(0).alias("query_id")).limit(1)
    return S.hybrid_search(_nodes(t), one, boost_repo="src3").select("query_id", "position", "id", "score")
