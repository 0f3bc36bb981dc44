"""The corpus pipeline: documents in, selected and encoded documents out.

Every stage works on all documents that the one before it kept.  All but the last
return the columns of ``documents``; ``n_chars`` follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrydex.llm import classifier, mixing, sentence_pieces, simhash, substring
from quarrydex.llm.common import materialize, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely of the highest grade than not.

    A null or blank text is graded as one without words; repeated rows are graded alike,
    and rows without an id too.  Without any usable rating every document is kept.
    """
    return classifier.select_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates (five-word shingles, similarity 0.8 or more).

    Null and blank texts are one group.  Repeated rows of the id that stays all stay, as
    do rows without an id; ties can't be, ids being ordered.
    """
    return simhash.keep_first(docs, simhash.similar_texts(docs)).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that an earlier document has.

    A document that loses all its words goes; one that had none stays as it is, null or
    blank.  Rows without an id and repeated rows of one id take nothing from each other.
    """
    return substring.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target asks for, a row a copy, in shuffled shards.

    The rows come shard by shard in the order of their slots, and are written so.  Null
    texts have no words, a null source is a source of its own, repeated rows are rows of
    their own; sources without words are taken no times.
    """
    return mixing.mix(docs).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; null and empty texts have none.  Every row stays, whatever its id."""
    return sentence_pieces.encode(docs).withColumn("n_tokens", F.size("ids").cast("long")).select("doc_id", "lang", "source", "text", "n_chars", "ids", "n_tokens")


STAGES = [
    ("quality classifier", select_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing", mix_sources),
    ("SentencePiece", encode_texts),
]
#: A trained classifier and a tokenizer can't be put into SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k + 1}")
    return docs
