"""Quality rules: per-text counts, and line frequency across a host's documents.

Everything is DataFrame expressions.  One pass over the texts leaves a small table
of counts and hashed lines; only lines and counters are shuffled, never texts, and
line counts are combined before the shuffle, so a line that a third of a host's
documents carry costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, ascii_lower, let, materialize, words_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A line is boilerplate in more than this many of its host's documents ...
MIN_DOCS = 5
#: ... and in more than this percentage of them.
HOST_PERCENT = 1
#: A document that keeps fewer words, or a smaller percentage of them, is depleted.
MIN_WORDS, LEAST_PERCENT = 10, 70


def _has_word(line: Column) -> Column:
    return F.translate(line, SEPARATORS, "") != ""


def repeated_window_words(words: Column, size: int = 5) -> Column:
    """How many words lie in ``size``-word windows that the text holds twice or more."""

    def windows(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]),
        )

    def covered(g: Column) -> Column:
        order = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(
            order,
            lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"]))),
        )
        at = F.sort_array(F.transform(twice, lambda x: x["p"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            at, zero, lambda a, p: F.struct((p + size).alias("end"), (a["n"] + F.least(F.lit(size), p + size - a["end"])).alias("n")), lambda a: a["n"]
        )

    def count(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashed, windows), count).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), _has_word)


def _normal(line: Column) -> Column:
    """A line after lower-casing A-Z and closing up white space."""
    return F.trim(F.regexp_replace(ascii_lower(line), WORD_SEPARATORS, " "))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Counts of each text, and its lines with a word: their hashes after normalising, and words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = _lines(F.col(text_col))
    hashed = F.transform(lines, lambda x: let(_normal(x), lambda y: F.struct(F.xxhash64(y).alias("line"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("words"))))
    return docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(host_col, F.lit("")), F.col(host_col).isNull()).alias("host"),
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        hashed.alias("lines"),
    ).select("row", "doc_id", "host", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "lines")


def common_lines(rows: DataFrame, min_docs: int, host_percent: float) -> DataFrame:
    """(host, line) found in more than ``min_docs`` documents and ``host_percent`` % of the host's.

    ``rows`` has row, doc_id, host and lines.  A document is an id, in whichever rows;
    a row without an id is a document of its own.
    """
    owner = F.when(F.col("doc_id").isNull(), F.struct(F.lit(True).alias("alone"), F.col("row").alias("id"))).otherwise(F.struct(F.lit(False).alias("alone"), F.xxhash64("doc_id").alias("id"))).alias("doc")
    spread = rows.select("host", owner, F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    hosts = rows.select("host", owner).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    # lines that few rows have can't be in many documents; the others are counted by distinct documents
    often = spread.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs).select("host", "line")
    counted = spread.join(often, ["host", "line"], "left_semi").distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > min_docs).join(hosts, "host").filter(F.col("n") * 100 > F.col("docs") * host_percent).select("host", "line")


def apply_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    *,
    min_docs: int = MIN_DOCS,
    host_percent: float = HOST_PERCENT,
    min_words: int = MIN_WORDS,
    least_percent: float = LEAST_PERCENT,
) -> DataFrame:
    """One row per row of ``docs``: its counts and whether it is kept.

    A text fails on its own (``base_failed``) with under ten words, or with over a
    fifth of them in repeated five-word windows.  Of the others, lines found in more
    than ``min_docs`` and ``host_percent`` % of their host's documents are taken out; a row
    with fewer than ``min_words`` words or ``least_percent`` % left isn't kept.
    ``n_common_lines`` and ``n_words_left`` tell what the second rule saw.

    A null text has no words and fails.  A null host is a host of its own.  Rows of one
    id are one document for the counts, and each is returned; rows without an id count
    and are returned like any other.
    """
    return _judged(materialize(measured(docs, id_col, text_col, host_col), "rules"), min_docs, host_percent, min_words, least_percent).drop("row", "common")


def clean_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    *,
    min_docs: int = MIN_DOCS,
    host_percent: float = HOST_PERCENT,
    min_words: int = MIN_WORDS,
    least_percent: float = LEAST_PERCENT,
) -> DataFrame:
    """The rows of ``docs`` that ``apply_rules`` keeps, their texts without the common lines.

    A text that has none stays as it is; of any other the lines with a word are joined
    by newlines.  All columns are returned; nulls and repeated rows as above.
    """
    whole = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("d")), "whole")
    rows = measured(whole.select("row", F.col("d")[id_col].alias("i"), F.col("d")[text_col].alias("t"), F.col("d")[host_col].alias("h")), "i", "t", "h", "row")
    kept = _judged(materialize(rows, "rules"), min_docs, host_percent, min_words, least_percent).filter("kept").select("row", "common")
    out = whole.join(kept, "row")
    left = F.array_join(F.filter(_lines(F.col("d")[text_col]), lambda x: ~F.array_contains("common", F.xxhash64(_normal(x)))), "\n")
    text = F.when(F.col("common").isNull(), F.col("d")[text_col]).otherwise(left)
    return out.select(*[text.alias(c) if c == text_col else F.col("d")[c].alias(c) for c in docs.columns])


def _judged(rows: DataFrame, min_docs: int, host_percent: float, min_words: int, least_percent: float) -> DataFrame:
    common = common_lines(rows, min_docs, host_percent)
    lines = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    lost = lines.join(common, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("gone"), F.count("*").alias("n_common_lines"), F.collect_set("line").alias("common"))
    out = rows.drop("lines", "host").join(lost, "row", "left").na.fill(0, ["gone", "n_common_lines"])
    left = F.col("n_words") - F.col("gone")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(
        "row", "common", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_lines",
        left.alias("n_words_left"), failed.alias("base_failed"),
        (~failed & (left >= min_words) & (left * 100 >= F.col("n_words") * least_percent)).alias("kept"),
    )


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('i' || doc_id, 'r' || row_number() OVER ()) AS doc, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rid, doc, source, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS raw FROM d),
n AS (SELECT rid, doc, source, raw, array_to_string(regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS line,
    len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS words FROM l),
h AS (SELECT source, count(DISTINCT doc) AS docs FROM d GROUP BY source),
c AS (SELECT n.source, n.line FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source GROUP BY n.source, n.line, h.docs
    HAVING count(DISTINCT doc) > {MIN_DOCS} AND count(DISTINCT doc) * 100 > h.docs * {HOST_PERCENT}),
g AS (SELECT n.rid, sum(n.words)::BIGINT AS gone, count(*) AS k FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source AND n.line = c.line GROUP BY n.rid),
u AS (SELECT rid, (count(*) - count(DISTINCT raw))::BIGINT AS n_dup_lines FROM l GROUP BY rid),
p AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
q AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS k FROM p) WHERE k > 1),
r AS (SELECT rid, count(DISTINCT i + j) AS n FROM q, (SELECT unnest(range(5)) AS j) GROUP BY rid),
m AS (SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(u.n_dup_lines, 0) AS n_dup_lines,
    length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    coalesce(g.k, 0) AS n_common_lines, len(w) - coalesce(g.gone, 0) AS n_words_left FROM d LEFT JOIN r USING (rid) LEFT JOIN u USING (rid) LEFT JOIN g USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_lines, n_words_left, base_failed,
    NOT base_failed AND n_words_left >= {MIN_WORDS} AND n_words_left * 100 >= n_words * {LEAST_PERCENT} AS kept FROM f
"""
