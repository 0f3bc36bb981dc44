"""Repeated passages found with phrase automata.

1. *Sample* (map side): of the eight-word phrases in every 50-word window the one
   with the smallest hash is the window's anchor.  Equal windows have equal
   anchors, so one distinct anchor in about twenty words is enough to meet them.
2. *Confirm*: anchors are counted over documents; a phrase that lies in two documents
   recurs.  Phrases travel as the codes of their words, without any position.
3. *Compile*: documents fall into shards of bounded size.  Each shard's confirmed
   phrases, with the first and last document of each, become an Aho-Corasick
   automaton over word codes; it holds no more phrases than the shard has words,
   whatever the corpus holds.
4. *Stream*: all documents of the shard run through the automaton, and what it reports
   is all that tells where confirmed phrases stand.
5. *Resolve*: windows whose anchor is such an occurrence meet by 128-bit hash; the smallest
   document of each is its first.  Windows of a phrase's last document can't be
   anyone's first, those of its first can't be removed; neither is sent.
6. *Remove*: words covered by windows whose first document is smaller.

Whole copies of a text are settled by text hash before step 1's anchors are counted,
so a group of thousands of copies costs one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, discard, materialize, prepare

#: Words of a window and of an anchor phrase.
WINDOW, PHRASE = 50, 8
#: Words that the documents of a shard have together, on average (memory of a task).
SHARD_WORDS = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(33))


def _runs(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every ``size`` consecutive word hashes."""
    out, have = h, 1
    for b in bin(size)[3:]:
        out = out[: len(out) - have] * _U(pow(int(base), have, 1 << 64)) + out[have:]
        have *= 2
        if b == "1":
            out = out[:-1] * base + h[have : have + len(out) - 1]
            have += 1
    return _mix(out)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def _phrases(words: list[bytes], phrase: int) -> np.ndarray:
    return _runs(np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), "<u8"), phrase, _ODD[0])


def anchor_runs(words: list[bytes], window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Runs of windows that share an anchor: first window and anchor position of each; number of windows."""
    g, span = _phrases(words, phrase), window - phrase + 1
    low = _sliding_min(g, span)
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return start, start + np.argmin(g[start[:, None] + np.arange(span)], axis=1), len(low)


def word_codes(words: list[bytes]) -> np.ndarray:
    """16 bits of each word; phrases whose codes agree by chance only cost a look at their windows."""
    return (np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), "<u8") >> _U(48)).astype(np.uint16)


def anchors(words: list[bytes], window: int, phrase: int) -> np.ndarray:
    """Distinct anchors of a document's windows: a row each, of two numbers that hold the phrase's codes."""
    if len(words) < window:
        return np.empty((0, 2), np.int64)
    at = np.unique(anchor_runs(words, window, phrase)[1])
    codes = np.zeros((len(at), 8), "<u2")
    codes[:, :phrase] = word_codes(words)[at[:, None] + np.arange(phrase)]
    return np.unique(codes.view("<i8").reshape(-1, 2), axis=0)


def window_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return tuple(_runs(np.ascontiguousarray(h[:, k]), window, _ODD[k]).view(np.int64) for k in (0, 1))


def _sample(window: int, phrase: int):
    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("substring")
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                words = text.split()
                found = anchors(words, window, phrase)
                rows.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest(), found[:, 0], found[:, 1]))
            n, sha, p, q = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tkey": pdf["tkey"], "th": pdf["th"], "n_words": n, "sha": sha, "p": p, "q": q})

    return sample


def compile_phrases(confirmed: pd.DataFrame, phrase: int) -> ahocorasick.Automaton:
    """The automaton of phrases (p, q); each reports its row's number."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    codes = np.ascontiguousarray(confirmed[["p", "q"]].to_numpy(np.int64)).view("<u2").reshape(-1, 8)[:, :phrase]
    for k, c in enumerate(codes.tolist()):
        automaton.add_word(tuple(c), k)
    automaton.make_automaton()
    return automaton


def _locate(window: int, phrase: int):
    def locate(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """A shard's documents through the automaton of its confirmed phrases."""
        out = []
        confirmed = known[known["alone"].isna()]
        if len(docs) and len(confirmed):
            alone = known[known["alone"].notna()]
            left = set(zip(alone["p"].tolist(), alone["q"].tolist()))
            automaton = compile_phrases(confirmed, phrase)
            first, last = confirmed["first"].tolist(), confirmed["last"].tolist()
            for doc_id, tkey, text in zip(docs["doc_id"].tolist(), docs["tkey"].tolist(), docs["text"]):
                if (doc_id, tkey) not in left:
                    continue
                left.discard((doc_id, tkey))
                words = text.split()
                # an occurrence is a source if a later document has its phrase, a target if an earlier one has it
                use = np.zeros(len(words), np.int8)
                for end, k in automaton.iter(tuple(word_codes(words).tolist())):
                    use[end - phrase + 1] = (doc_id < last[k]) + 2 * (doc_id > first[k])
                if not use.any():
                    continue
                begin, at, n = anchor_runs(words, window, phrase)
                use = np.repeat(use[at], np.diff(np.append(begin, n)))
                start = np.flatnonzero(use)
                if len(start):
                    h1, h2 = window_hashes(words, window)
                    out.append((doc_id, tkey, text if (use & 2).any() else None, start.astype(np.int32), h1[start], h2[start], use[start].astype(np.int32)))
        return pd.DataFrame(out, columns=["doc_id", "tkey", "text", "start", "h1", "h2", "use"])

    return locate


def _cut(window: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, starts in zip(pdf["text"], pdf["starts"]):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(starts)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, x in zip(words, gone.tolist()) if not x)
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
                rows.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), [{"first": int(a), "stop": int(b)} for a, b in turn]))
            n, sha, kept, spans = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tkey": pdf["tkey"], "n_removed": n, "sha": sha, "kept": kept, "spans": spans})

    return cut


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text")), text


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, phrase: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row per document, and one per document that keeps only a part.

    The first: ``doc_id``, ``tkey`` (text key), ``n_words``, ``sha`` (SHA-256 of the
    words joined by one space) and ``first_id``, the smallest id with the same whole
    text.  The second: ``doc_id``, ``tkey``, ``n_removed``, ``sha``, ``kept`` (the kept
    words joined by one space) and ``spans`` of removed words.  A document of at least
    ``window`` words with ``first_id < doc_id`` is in no row of the second: all of it
    goes.  Null and blank texts have no words.  Rows without an id take part in
    nothing.  Repeated rows and several texts of one id never remove each other.
    """
    keyed, _ = _keyed(docs, id_col, text_col)
    if not 1 <= phrase <= min(8, window):
        raise ValueError("phrase must be from 1 to 8 words, and no longer than the window")
    sampled = materialize(
        keyed.withColumn("th", F.unhex(F.sha2("text", 256))).mapInPandas(_sample(window, phrase), "doc_id long, tkey long, th binary, n_words long, sha string, p array<long>, q array<long>"),
        "anchors",
    )
    known = sampled.filter("doc_id IS NOT NULL")
    firsts = known.groupBy("th").agg(F.min("doc_id").alias("first_id"))
    each = sampled.select("doc_id", "tkey", "th", "n_words", "sha")
    each = materialize(each.join(firsts, "th", "left").select("doc_id", "tkey", "n_words", "sha", "first_id"), "each")

    # one document stands for all that have its text
    alone = each.filter("first_id = doc_id AND n_words >= %d" % window).select("doc_id", "tkey").distinct()
    shards = max(1, -(-(each.agg(F.sum("n_words")).first()[0] or 0) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("doc_id", "tkey"), F.lit(shards)).alias("shard")
    placed = known.join(alone, ["doc_id", "tkey"], "left_semi").select("doc_id", shard, F.explode(F.arrays_zip("p", "q")).alias("x")).select("doc_id", "shard", "x.p", "x.q")
    recurring = placed.groupBy("p", "q").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    confirmed = placed.select("shard", "p", "q").distinct().join(recurring, ["p", "q"])
    # texts are sent once, to their shards; there the rows marked as alone tell which documents stand for their copies
    stand = alone.select(shard, F.col("doc_id").alias("p"), F.col("tkey").alias("q"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit(True).alias("alone"))
    known_there = confirmed.select("shard", "p", "q", "first", "last", F.lit(None).cast("boolean").alias("alone")).unionAll(stand)
    least = 2 * window - 1  # bytes of the shortest text with a window
    texts = keyed.filter((F.col("doc_id").isNotNull()) & (F.octet_length("text") >= least)).select("doc_id", "tkey", "text", shard)
    located = materialize(
        texts.groupBy("shard").cogroup(known_there.groupBy("shard")).applyInPandas(_locate(window, phrase), "doc_id long, tkey long, text binary, start array<int>, h1 array<long>, h2 array<long>, use array<int>"),
        "located",
    )
    discard(sampled)
    windows = located.select("doc_id", "tkey", F.explode(F.arrays_zip("start", "h1", "h2", "use")).alias("x")).select("doc_id", "tkey", "x.*")
    first = windows.filter("use & 1 = 1").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    late = windows.filter("use & 2 = 2").join(first, ["h1", "h2"]).filter("first < doc_id")
    starts = late.groupBy("doc_id", "tkey").agg(F.collect_set("start").alias("starts"))
    part = located.filter("text IS NOT NULL").select("doc_id", "tkey", "text").dropDuplicates(["doc_id", "tkey"]).join(starts, ["doc_id", "tkey"])
    parts = part.mapInPandas(_cut(window), "doc_id long, tkey long, n_removed long, sha string, kept string, spans array<struct<first:int,stop:int>>")
    parts = materialize(parts, "parts")
    discard(located)
    return each, parts


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256``."""
    each, parts = find_repeats(docs, window=window)
    parts = parts.select("doc_id", "tkey", F.col("n_removed").alias("r"), F.col("sha").alias("s"))
    whole = (F.col("first_id") < F.col("doc_id")) & (F.col("n_words") >= window)
    return each.join(parts, ["doc_id", "tkey"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("s", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW) -> DataFrame:
    """``docs`` without repeated passages; documents with no word left go.

    A text that loses words becomes its kept words joined by one space; any other
    stays as it is.  Documents that had no words to begin with stay.
    """
    each, parts = find_repeats(docs, id_col, text_col, window=window)
    gone = each.filter((F.col("first_id") < F.col("doc_id")) & (F.col("n_words") >= window))
    change = parts.select("doc_id", "tkey", F.col("kept").alias("kept")).unionAll(gone.select("doc_id", "tkey", F.lit("").alias("kept")).distinct())
    change = change.select(F.struct("doc_id", "tkey", "kept").alias("c"))
    rows = docs.select(F.struct(*docs.columns).alias("d"))
    key = F.xxhash64(F.coalesce(F.col("d")[text_col].cast("binary"), F.lit(b"")))
    joined = rows.join(change, (F.col("d")[id_col].cast("long") == F.col("c.doc_id")) & (key == F.col("c.tkey")), "left")
    left = joined.filter("c.kept IS NULL OR c.kept <> ''")
    return left.select(*[F.coalesce("c.kept", F.col("d")[c]).alias(c) if c == text_col else F.col("d")[c].alias(c) for c in docs.columns])


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM p) WHERE first < doc_id),
g AS (SELECT DISTINCT rid, i + j AS pos FROM r, (SELECT unnest(range({WINDOW})) AS j)),
n AS (SELECT rid, count(*) AS n, list(pos) AS gone FROM g GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
    sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, k: NOT list_contains(gone, k)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN n USING (rid)
"""
