"""Evidence files in CSV, JSON and XML as one frame of raw fields, and its validation.

Readers never infer types: all cells are strings and amounts keep their digits.  A record that its reader cannot take
apart has ``broken`` set; nothing is dropped before it is counted.
"""

from __future__ import annotations

import csv
import io
import json
import os
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C

# Fields of a record, in order; lists; fields a CSV file may lack
FIELDS = ["timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "txid", "input_addresses", "output_addresses", "input_amounts", "output_amounts", "fee", "script_type", "geo_country", "asn"]
LISTS = ["input_addresses", "output_addresses", "input_amounts", "output_amounts"]
OPTIONAL = ["fee", "script_type", "geo_country", "asn"]
SEPARATOR = ";"

_BROKEN = "_corrupt_record"


class EvidenceError(ValueError):
    """A file that cannot be read as evidence at all."""


def _column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("array<string>" if name in LISTS else "string")


def _first_text(spark: SparkSession, path: str) -> str:
    for r in spark.read.text(path).where("trim(value) <> ''").limit(1).collect():
        return r["value"]
    return ""


def _quotes_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, as a record with a line break within quotes must have."""
    return bool(spark.read.text(path).where("(length(value) - length(replace(value, '\"', ''))) % 2 = 1").limit(1).count())


def read_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """CSV with a header that gives the columns' places; ten columns are required.  Ragged rows are broken.

    ``multiline`` allows line breaks within quotes, at the price of one task per file; where it is not given, the file's
    quotes tell whether it is needed.  A cell whose quote is never closed then reaches to the end of the file.
    """
    if multiline is None:
        multiline = _quotes_span_lines(spark, path)
    header = next(csv.reader(io.StringIO(_first_text(spark, path).lstrip("﻿"))), [])
    missing = [f for f in FIELDS if f not in header and f not in OPTIONAL]
    if missing:
        raise EvidenceError(f"missing column: {missing[0]}")
    schema = ", ".join(f"`{h}` string" for h in header) + f", {_BROKEN} string"
    df = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN, escape='"', multiLine=multiline, enforceSchema=True)
    split = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(c, SEPARATOR, -1))
    # a blank cell of a column that is there is read as null by the CSV reader
    cells = [(split(_column(df, f)) if f in LISTS else F.coalesce(_column(df, f), F.lit("" if f in df.columns else None))).alias(f) for f in FIELDS]
    return df.select(*cells, F.col(_BROKEN).isNotNull().alias("broken"))


def _is_document(spark: SparkSession, path: str) -> bool:
    """Whether the whole file is one JSON value; it is streamed, up to the first error, and never held."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        parser = jvm.com.fasterxml.jackson.core.JsonFactory().createParser(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        parser.enable(getattr(jvm.com.fasterxml.jackson.core, "JsonParser$Feature").ALLOW_SINGLE_QUOTES)  # as Spark's reader
        parser.nextToken()
        parser.skipChildren()
        return parser.nextToken() is None
    except Py4JJavaError as e:
        if not jvm.java.lang.Class.forName("com.fasterxml.jackson.core.JsonProcessingException").isInstance(e.java_exception):
            raise
        return False
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records or a single one, else a record per line; a line that is no record is broken.

    Numbers are read as text, so amounts keep their digits.  A file with content but without records is one broken record
    if it is a document, else one for each line.
    """
    schema = ", ".join(f"{f} {'array<string>' if f in LISTS else 'string'}" for f in FIELDS) + f", {_BROKEN} string"
    head = _first_text(spark, path)
    whole = head.lstrip().startswith(("[", "{"))
    if whole and head.lstrip().startswith("{"):
        try:
            json.loads(head)
            whole = False
        except ValueError:
            pass
    whole = whole and _is_document(spark, path)
    df = spark.read.json(path, schema=schema, multiLine=whole, mode="PERMISSIVE", columnNameOfCorruptRecord=_BROKEN)
    cells = [F.coalesce(F.filter(f, lambda x: x.isNotNull()), F.expr("cast(array() as array<string>)")).alias(f) if f in LISTS else F.col(f) for f in FIELDS]
    return df.select(*cells, F.col(_BROKEN).isNotNull().alias("broken"))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """XML with a row per ``observation`` and lists of ``item``; a truncated end is one broken record, what precedes it is kept."""
    schema = ", ".join(f"{f} {'struct<item:array<string>>' if f in LISTS else 'string'}" for f in FIELDS) + f", {_BROKEN} string"
    df = spark.read.format("xml").schema(schema).option("rowTag", "observation").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).load(path)
    # an empty item is none; a blank fee is 0
    lists = lambda f: F.coalesce(F.filter(F.col(f"{f}.item"), lambda x: x.isNotNull() & (x != "")), F.expr("cast(array() as array<string>)"))
    cells = [lists(f).alias(f) if f in LISTS else F.when(F.col(f) == "", None).otherwise(F.col(f)).alias(f) for f in FIELDS]
    return df.select(*cells, F.col(_BROKEN).isNotNull().alias("broken"))


READERS = {".csv": read_csv, ".json": read_json, ".jsonl": read_json, ".xml": read_xml}


def read_evidence(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """The records of all files (with file_no and record_no, their order) and the files that failed, with why.

    The reader is chosen by the extension; a file that fails is reported and does not end the run.
    """
    frames, failed = [], {}
    for i, path in enumerate(paths):
        reader = READERS.get(os.path.splitext(path)[1].lower())
        if reader is None:
            failed[path] = "unsupported extension"
            continue
        try:
            frames.append(reader(spark, path).select(F.lit(i).alias("file_no"), F.monotonically_increasing_id().alias("record_no"), *FIELDS, "broken"))
        except Exception as e:
            failed[path] = str(e).split("\n")[0]
    return (reduce(DataFrame.unionByName, frames) if frames else None), failed


def validated(raw: DataFrame) -> DataFrame:
    """Typed columns and ``valid``: not broken, and timestamp, ports, amounts and fee as they should be, txid not empty.

    A missing fee or port is 0, a missing text empty, an AS number that is none 0.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ts = C.evidence_micros(F.col("timestamp"))
    fee = F.when(F.col("fee").isNull(), F.lit(0).cast("bigint")).otherwise(C.satoshis(F.col("fee")))
    port = lambda c: F.when(C.port_ok(text(c)), F.coalesce(C.port(text(c)), F.lit(0)))
    sats = lambda c: F.transform(c, C.satoshis)
    asn = F.coalesce(F.trim(text("asn")).try_cast("bigint"), F.lit(0).cast("bigint"))
    typed = raw.select(
        "file_no", "record_no", ts.alias("ts_micro"), F.col("src_ip"), port("src_port").alias("src_port"), F.col("dst_ip"), port("dst_port").alias("dst_port"), text("txid").alias("txid"),
        "input_addresses", "output_addresses", sats("input_amounts").alias("input_amounts"), sats("output_amounts").alias("output_amounts"), fee.alias("fee"), text("script_type").alias("script_type"),
        text("geo_country").alias("geo_country"), asn.alias("asn"), "broken",
    )
    whole = lambda c: F.forall(c, lambda x: x.isNotNull())
    valid = ~F.col("broken") & F.col("ts_micro").isNotNull() & F.col("src_port").isNotNull() & F.col("dst_port").isNotNull() & F.col("fee").isNotNull() & whole("input_amounts") & whole("output_amounts") & (F.col("txid") != "")
    return typed.withColumn("src_ip", text("src_ip")).withColumn("dst_ip", text("dst_ip")).withColumn("valid", F.coalesce(valid, F.lit(False))).drop("broken")
