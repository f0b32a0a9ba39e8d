"""Sightings as a stream: files that arrive, de-duplicated within a watermark, appended to a table or counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "txid string, ts_micro bigint, src_ip string, src_port int, dst_ip string, dst_port int, geo_country string, asn bigint, asn_org string, country_source string, asn_source string, arrival_rank bigint"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The sightings of Parquet files as they arrive in ``folder``, with the event time ``at``."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("at", F.timestamp_micros("ts_micro"))


def once(rows: DataFrame, lateness: str = "7 days") -> DataFrame:
    """One of the sightings that agree in (txid, ts_micro, src_ip) within the lateness; state is bounded by it."""
    return rows.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["txid", "ts_micro", "src_ip"])


def per_window(rows: DataFrame, window: str = "1 hour", lateness: str = "7 days") -> DataFrame:
    """Sightings and distinct hosts (approximate) per window of event time."""
    by = rows.withWatermark("at", lateness).groupBy(F.window("at", window).alias("w"))
    return by.agg(F.count("*").alias("sightings"), F.approx_count_distinct("src_ip").alias("hosts")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "sightings", "hosts")


def append(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to a Parquet table and stop."""
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
