"""From evidence files to the store: ledger and network tables and a manifest with the hashes of the sources."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import observations as O
from ..shared import materialize
from . import files
from .evidence import read_evidence, validated
from .geo import enrich


def write_table(df: DataFrame, path: str, by: str | None = None, order: list[str] | None = None) -> None:
    """Write a table whole or not at all: beside its place first, then renamed.  Rows of a key lie together, sorted."""
    spark = df.sparkSession
    if by:
        df = df.repartition(by)
    if order:
        df = df.sortWithinPartitions(*order)
    beside = f"{path}.writing"
    df.write.mode("overwrite").parquet(beside)
    jvm = spark.sparkContext._jvm
    new, place = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(place, True)
    if not fs.rename(new, place):
        raise OSError(f"could not rename {beside}")


@dataclass
class Ingested:
    tx: DataFrame
    l2: DataFrame
    manifest: dict
    failed: dict[str, str]


def ingest(spark: SparkSession, paths: list[str], out: str, geo_ranges: DataFrame | None = None, manifest: str | None = None) -> Ingested:
    """Read, validate, de-duplicate on (txid, ts_micro, src_ip) in file order, enrich, and write tx_l1 and net_l2.

    A run without a valid record raises ValueError.
    """
    raw, failed = read_evidence(spark, paths)
    rows = materialize(validated(raw), "evidence") if raw is not None else None
    counts = rows.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("rejected")).first() if rows is not None else {"valid": 0, "rejected": 0}
    if not counts["valid"]:
        raise ValueError("no valid record in any input")
    once = materialize(O.keep_first(rows.where("valid").drop("valid"), ["txid", "ts_micro", "src_ip"], ["file_no", "record_no"]), "once")
    n = once.count()
    bare = once.withColumns({"asn_org": F.lit(""), "country_source": F.lit("record"), "asn_source": F.lit("record")})
    placed = enrich(bare, geo_ranges) if geo_ranges is not None else bare
    ranked = O.arrival_rank(placed, tie_break=["file_no", "record_no"]).withColumnRenamed("rank", "arrival_rank")
    l2 = ranked.select("txid", "ts_micro", "src_ip", "src_port", "dst_ip", "dst_port", "geo_country", "asn", "asn_org", "country_source", "asn_source", "arrival_rank")
    ledger = ["ts_micro", "input_addresses", "output_addresses", "input_amounts", "output_amounts", "fee", "script_type"]
    first = O.earliest(once, order=["ts_micro", "file_no", "record_no"], columns=ledger)
    tx = first.join(O.derived_totals(first), "txid").select("txid", *ledger, "n_inputs", "n_outputs", "total_in", "total_out")
    write_table(tx, f"{out}/tx_l1.parquet", "txid", ["txid"])
    write_table(l2, f"{out}/net_l2.parquet", "txid", ["txid", "ts_micro"])
    tx, l2 = spark.read.parquet(f"{out}/tx_l1.parquet"), spark.read.parquet(f"{out}/net_l2.parquet")
    from_db = O.provenance_counts(l2).first()
    # The manifest's keys
    record = {
        "ingested_at_unix": int(time.time()),
        "transactions": tx.count(),
        "observations": n,
        "rejected_records": counts["rejected"],
        "duplicate_records": counts["valid"] - n,
        "geoip_database_present": geo_ranges is not None,
        "geo_from_database": from_db["geo_from_database"],
        "geo_from_record": from_db["geo_from_record"],
        "sources": files.hashes(spark, paths),
    }
    if manifest:
        files.write_text(spark, manifest, json.dumps(record, indent=2) + "\n")
    return Ingested(tx, l2, record, failed)
