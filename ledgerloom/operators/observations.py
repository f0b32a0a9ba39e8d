"""Sightings and ledger rows: keep-first de-duplication, arrival ranks, earliest sighting, derived totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of sightings that agree in time; makes every selection below a function of the rows.
TIE_BREAK = ["src_ip", "src_port", "dst_ip", "dst_port", "asn", "geo_country", "arrival_rank"]


def _order(columns: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (nulls last).  Null keys are keys like any other."""
    first = Window.partitionBy(*keys).orderBy(*_order(order))
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def duplicate_count(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_rows, n_keys, n_duplicates."""
    by = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def arrival_rank(rows: DataFrame, key: str = "txid", time: str = "ts_micro", tie_break: list[str] | None = None) -> DataFrame:
    """Dense rank 1..n of the rows of each key by time (column ``rank``), ties in a fixed order, null times last."""
    w = Window.partitionBy(key).orderBy(*_order([time, *(TIE_BREAK if tie_break is None else tie_break)]))
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint"))


def earliest(rows: DataFrame, key: str = "txid", order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The earliest row of each key, by an aggregate that combines before the shuffle.  Rows without a time come last."""
    order = ["ts_micro", *TIE_BREAK] if order is None else order
    columns = [c for c in rows.columns if c != key] if columns is None else columns
    # a null is made the greatest by a leading flag
    rank = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c).alias(f"_o_{c}"))))
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), rank).alias("_first"))
    return best.select(key, "_first.*")


def derived_totals(tx: DataFrame) -> DataFrame:
    """n_inputs, n_outputs, total_in, total_out worked out from the arrays (null amounts and arrays count as nothing)."""
    total = lambda c: F.aggregate(F.coalesce(F.col(c), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return tx.select("txid", size("input_addresses").alias("n_inputs"), size("output_addresses").alias("n_outputs"), total("input_amounts").alias("total_in"), total("output_amounts").alias("total_out"))


def conservation(tx: DataFrame) -> DataFrame:
    """Transactions that do not add up: their inputs differ from outputs plus fee, or parallel arrays in length."""
    d = derived_totals(tx.select("txid", "input_addresses", "output_addresses", "input_amounts", "output_amounts").distinct())
    fees = tx.groupBy("txid").agg(F.min("fee").alias("fee"), F.min(F.size("input_amounts")).alias("n_in_amounts"), F.min(F.size("output_amounts")).alias("n_out_amounts"))
    j = d.join(fees, "txid")
    gap = F.col("total_in") - F.col("total_out") - F.col("fee")
    aligned = (F.col("n_inputs") == F.col("n_in_amounts")) & (F.col("n_outputs") == F.col("n_out_amounts"))
    return j.where((F.coalesce(gap, F.lit(0)) != 0) | ~aligned).select("txid", gap.alias("gap"), aligned.alias("aligned"))


def provenance_counts(l2: DataFrame) -> DataFrame:
    """How many sightings took country and AS number from the database and how many from the record."""
    both = (F.col("country_source") == "db") & (F.col("asn_source") == "db")
    return l2.agg(F.count("*").alias("observations"), F.count_if(both).alias("geo_from_database"), (F.count("*") - F.count_if(both)).alias("geo_from_record"))
