"""Queries of the operators for text data, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.llm import byte_bpe, conversations, lookalike, packing, personal, residue, shared_spans
from kairolog.session import table


def messages(spark: SparkSession, d: str) -> DataFrame:
    """``src_table, row_id, text`` of both tables of messages."""
    meta = table(spark, d, "meta").select(F.lit("meta").alias("src_table"), F.col("rowid").alias("row_id"), "text")
    return meta.unionByName(table(spark, d, "sample_log").select(F.lit("sample_log").alias("src_table"), F.col("log_id").alias("row_id"), "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_looking_pairs(table(spark, d, "meta")).select(F.col("a").alias("rowid_a"), F.col("b").alias("rowid_b"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same as classes: as many rows as keys, however large a class is."""
    return lookalike.same_looking_classes(table(spark, d, "meta"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.items(messages(spark, d), ["src_table", "row_id"]).select("src_table", "row_id", F.explode("kinds").alias("kind")).distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every message, with placeholders where it has personal items."""
    return personal.items(messages(spark, d), ["src_table", "row_id"], every=True).select("src_table", "row_id", F.col("redacted").alias("text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.positions(table(spark, d, "sample_log"), table(spark, d, "config_example"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(messages(spark, d), ["src_table", "row_id"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.encode(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_chars(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_classes, p3_found, p3_redacted, p5_found, p7_found, p8_ids, p9_containers, p10_found)}


def oracle_sql() -> dict[str, str]:
    return {}
