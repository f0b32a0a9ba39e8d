"""Separating records that fail to parse, with the reason, from those that load.

Parsed cells are exploded into (row, column, value), a rule table says how each column is checked, the failures
are aggregated to one reason per row, and the clean rows are those left by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..shared import materialize

#: Reasons in order of precedence.
REASONS = ["quoting", "column_count", "timestamp", "src_port", "input_amounts", "fee"]

#: Kind of check by column; columns that are not named are not checked.
CHECKS = {"timestamp": "timestamp", "src_port": "port", "input_amounts": "amounts", "fee": "amount"}


def rule_table(layout: DataFrame) -> DataFrame:
    """One row per checked column: pos (1-based), reason, check and rank of the reason.  Bounded by the columns."""
    named = layout.select(F.col("pos").cast("int").alias("pos"), F.trim("field_name").alias("reason"))
    rules = layout.sparkSession.createDataFrame([(n, k, REASONS.index(n)) for n, k in CHECKS.items()], "reason string, check string, rank int")
    return named.join(F.broadcast(rules), "reason").select("pos", "check", "rank")


def _passes(check: Column, value: Column) -> Column:
    return F.when(check == "timestamp", C.timestamp_ok(value)).when(check == "port", C.port_ok(value)).when(check == "amounts", C.amounts_ok(value)).when(check == "amount", C.amount_ok(value)).otherwise(True)


def _parsed(raw: DataFrame) -> DataFrame:
    line = F.col("raw_line")
    quoting = F.coalesce(C.quoting_ok(line), F.lit(True))
    return raw.select("line_id", "raw_line", quoting.alias("quoting"), F.when(quoting & line.isNotNull(), C.cells(line)).alias("cells"))


def invalid_rows(raw: DataFrame, layout: DataFrame) -> DataFrame:
    """(line_id, reason): one row per invalid record with the first of its reasons in the order of ``REASONS``.

    A null line fails by ``column_count``, as does an empty one (a single cell).  Repeated lines are judged each,
    by their line_id, which must be unique.  Line breaks inside quotes belong to the record; cells and lines may be of any
    length.  An empty table gives no rows; other columns are not read.
    """
    width = layout.count()
    parsed = _parsed(raw)
    # a record of the wrong width is one row of the exploded form, under a column 0 that the rules do not know
    shape = F.when(~F.col("quoting"), REASONS.index("quoting")).when(F.coalesce(F.size("cells"), F.lit(-1)) != width, REASONS.index("column_count"))
    exploded = parsed.withColumn("shape", shape).select(
        "line_id", "shape", F.posexplode(F.when(F.col("shape").isNull(), F.col("cells")).otherwise(F.array(F.lit("")))).alias("at", "value")
    )
    wanted = exploded.withColumn("pos", F.when(F.col("shape").isNull(), F.col("at") + 1).otherwise(0))
    judged = wanted.join(F.broadcast(rule_table(layout)), "pos", "left")
    failed = judged.select("line_id", F.coalesce("shape", F.when(~_passes(F.col("check"), F.col("value")), F.col("rank"))).alias("rank"))
    first = failed.where("rank is not null").groupBy("line_id").agg(F.min("rank").alias("rank"))
    names = F.array(*map(F.lit, REASONS))
    return first.select(F.col("line_id").cast("bigint").alias("line_id"), F.get(names, F.col("rank")).alias("reason"))


def _without(raw: DataFrame, invalid: DataFrame) -> DataFrame:
    """The rows of ``raw`` that are not invalid; a null line_id is an id like any other."""
    bad = invalid.select(F.col("line_id").alias("_bad"))
    return raw.join(bad, F.col("line_id").eqNullSafe(F.col("_bad")), "left_anti")


def valid_rows(raw: DataFrame, layout: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """The valid records as typed rows, in the columns of ``layout`` after line_id.

    Text is trimmed; timestamp is in microseconds, amounts are lists of satoshis, fee is in satoshis, ports are integers
    (null where blank or no number), asn is a bigint (null where it is no number); address lists are arrays.
    """
    invalid = invalid_rows(raw, layout) if invalid is None else invalid
    clean = _without(raw, invalid)
    split = _parsed(clean)
    columns = [F.col("line_id").cast("bigint").alias("line_id")]
    # the layout is a table of a few rows (one per column of a record)
    for r in sorted(layout.select("pos", "field_name").collect()):
        name, cell = r["field_name"].strip(), F.get("cells", F.lit(r["pos"] - 1))
        if name == "timestamp":
            typed = C.micros(cell)
        elif name in ("src_port", "dst_port"):
            typed = C.port(cell)
        elif name in ("input_amounts", "output_amounts"):
            typed = C.amounts(cell)
        elif name == "fee":
            typed = C.satoshis(cell)
        elif name in ("input_addresses", "output_addresses"):
            typed = F.when(F.trim(cell) == "", F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.split(cell, ";", -1), lambda x: F.trim(x)))
        elif name == "asn":
            typed = F.trim(cell).try_cast("bigint")
        else:
            typed = F.trim(cell)
        columns.append(typed.alias(name))
    return split.select(*columns)


def reason_counts(raw: DataFrame, layout: DataFrame) -> DataFrame:
    """Number of records per outcome, ``valid`` included."""
    bad = materialize(invalid_rows(raw, layout), "invalid")
    good = _without(raw, bad).select(F.lit("valid").alias("reason"))
    return bad.select("reason").unionByName(good).groupBy("reason").agg(F.count("*").alias("n"))
