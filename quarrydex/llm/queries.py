"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, embed_dedup, html_extract, mixing, quality_rules, sentence_pieces, sharding, simhash, substring, url_filter
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_documents(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classifier.graded(spark, docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_top", 6).alias("p_top"), "kept")


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.apply_lists(url_filter.dated(pages), url_filter.list_events(pages))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.source_targets(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_quality_rules, op3_sentence_pieces, op4_embed_dedup, op5_substring, op6_mixing, op7_url_filter, op8_html_extract, op9_classifier, op10_sharding, mixing_targets)
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "mixing_targets": mixing.TARGETS_SQL,
    "op4_embed_dedup": embed_dedup.ORACLE_SQL,
    "op5_substring": substring.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
}
