"""Queries of the text problems p6 to p8 over the table documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialize
from . import packing, spans, tokens

#: Tokens per container.
CAPACITY = 2048


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_documents(spark, d))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its number of ids and whether they decode to its text (a null one to an empty text)."""
    documents = _documents(spark, d)
    encoded = materialize(tokens.encode(documents), "encoded")
    back = tokens.decode(encoded).select("doc_id", F.sha2("text", 256).alias("decoded"))
    there = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return there.join(back, "doc_id").join(encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids")), "doc_id").select("doc_id", "n_ids", (F.col("digest") == F.col("decoded")).alias("same"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.sizes(_documents(spark, d)), CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d), CAPACITY)


def p7_bound(spark: SparkSession, d: str) -> DataFrame:
    return packing.bound_report(p7_containers(spark, d), CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(_documents(spark, d))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.coverage(_documents(spark, d))


def p8_removed(spark: SparkSession, d: str) -> DataFrame:
    return spans.removed_spans(_documents(spark, d))


def p8_lines(spark: SparkSession, d: str) -> DataFrame:
    return spans.repeated_units(_documents(spark, d), "line")


def p8_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return spans.repeated_units(_documents(spark, d), "paragraph")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p6_ids, p6_round_trip, p7_containers, p7_fill, p7_bound, p8_found, p8_coverage, p8_removed, p8_lines, p8_paragraphs)
}

#: SQL cannot express these operators; tests hold them against brute force, the tokenizer itself and round trips.
SQL: dict[str, str] = {}
