import csv
import io
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import quarantine as Q
from tests.conftest import rows

NAMES = ["timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "txid", "input_addresses", "output_addresses", "input_amounts", "output_amounts", "fee", "script_type", "geo_country", "asn"]
GOOD = ["2027-01-02T03:04:05.123456789Z", "10.0.0.1", "8333", "10.0.0.2", "8333", "ab", "a;b", "c", "0.5;1.", "1.49", "0.01", "p2sh", "DE", "64512"]


def layout(spark):
    return spark.createDataFrame([(i + 1, n, "text") for i, n in enumerate(NAMES)], "pos int, field_name string, field_kind string")


def frame(spark, lines):
    return spark.createDataFrame([(i, x, "s", None) for i, x in enumerate(lines)], "line_id bigint, raw_line string, source_file string, reason string")


def line(**cells):
    return ",".join(cells.get(n, g) for n, g in zip(NAMES, GOOD))


CASES = [
    (line(), None),
    (None, "column_count"),
    ("", "column_count"),
    (line() + ",x", "column_count"),
    (line(txid='"a,b"'), None),
    (line(txid='"a\nb"'), None),
    (line(txid='"a ""q"" b"'), None),
    (line(txid='""'), None),
    (line(txid='""""'), None),
    (line(txid='"a'), "quoting"),
    (line(txid='a"b'), "quoting"),
    (line(txid=' "a"'), "quoting"),
    (line(txid='"a" '), "quoting"),
    (line(txid='"a"b"'), "quoting"),
    (line(txid='"') + ",x,y", "quoting"),
    (line(timestamp='" 2027-01-02T03:04:05Z "'), None),
    (line(timestamp="2027-01-02T03:04:05+23:59"), None),
    (line(timestamp="2027-01-02T03:04:05"), "timestamp"),
    (line(timestamp="2027-01-02T03:04:05.Z"), "timestamp"),
    (line(timestamp="2027-01-02T03:04:05.1234567890Z"), "timestamp"),
    (line(timestamp="2027-02-29T03:04:05Z"), "timestamp"),
    (line(timestamp="2028-02-29T03:04:05Z"), None),
    (line(timestamp="2027-01-02T24:04:05Z"), "timestamp"),
    (line(timestamp="2027-01-02T23:60:05Z"), "timestamp"),
    (line(timestamp="2027-01-02T23:00:60Z"), "timestamp"),
    (line(timestamp="٢027-01-02T23:00:00Z"), "timestamp"),
    (line(timestamp="2027-01-02T23:00:00Z\n"), "timestamp"),
    (line(timestamp=""), "timestamp"),
    (line(src_port=""), None),
    (line(src_port="   "), None),
    (line(src_port="0000000000000065535"), None),
    (line(src_port="65536"), "src_port"),
    (line(src_port="99999999999999999999999"), "src_port"),
    (line(src_port="+1"), "src_port"),
    (line(src_port="1.0"), "src_port"),
    (line(input_amounts=""), None),
    (line(input_amounts=" ; "), "input_amounts"),
    (line(input_amounts="1;"), "input_amounts"),
    (line(input_amounts="1; 2"), None),
    (line(input_amounts="."), "input_amounts"),
    (line(input_amounts=".5;-1;+1.00000000"), None),
    (line(input_amounts="1.000000000"), "input_amounts"),
    (line(input_amounts="92233720368.54775807"), None),
    (line(input_amounts="92233720368.54775808"), "input_amounts"),
    (line(input_amounts="-92233720368.54775808"), None),
    (line(input_amounts="-92233720368.54775809"), "input_amounts"),
    (line(input_amounts="0000000000000000000000000000001"), None),
    (line(fee=""), "fee"),
    (line(fee="1e-8"), "fee"),
    (line(fee="1.2.3"), "fee"),
    (line(fee="--1"), "fee"),
    (line(timestamp="x", fee="x", src_port="x"), "timestamp"),
    (line(fee="x", src_port="x"), "src_port"),
    (line(txid="\x01s\x01e"), None),
]


def test_reasons(spark):
    got = dict(rows(Q.invalid_rows(frame(spark, [c for c, _ in CASES]), layout(spark))))
    assert got == {i: r for i, (_, r) in enumerate(CASES) if r}


def test_valid_rows_are_typed(spark):
    raw = frame(spark, [line(txid='"a ""q"", \x01 b"', timestamp="2027-01-01T01:00:00.5+02:00"), line(fee="x"), line(src_port="", input_amounts="")])
    got = {r["line_id"]: r for r in Q.valid_rows(raw, layout(spark)).collect()}
    assert set(got) == {0, 2}
    assert got[0]["txid"] == 'a "q", \x01 b'
    assert got[0]["timestamp"] == int(datetime(2026, 12, 31, 23).timestamp() - datetime(1970, 1, 1).timestamp()) * 1_000_000 + 500_000
    assert got[0]["input_amounts"] == [50_000_000, 100_000_000]
    assert (got[0]["fee"], got[0]["src_port"], got[0]["asn"], got[0]["input_addresses"]) == (1_000_000, 8333, 64512, ["a", "b"])
    assert (got[2]["src_port"], got[2]["input_amounts"]) == (None, [])


def test_very_long_lines(spark):
    many = '"' + 'a""' * 60_000 + '"'
    got = dict(rows(Q.invalid_rows(frame(spark, [line(txid=many), "," * 200_000, line(input_amounts=";".join(["0.1"] * 50_000)), '"' * 100_001]), layout(spark))))
    assert got == {1: "column_count", 3: "quoting"}


def test_empty_table_and_counts(spark):
    assert rows(Q.invalid_rows(frame(spark, []), layout(spark))) == []
    assert rows(Q.reason_counts(frame(spark, [line(), None, None]), layout(spark))) == [("column_count", 2), ("valid", 1)]
    nameless = frame(spark, [None]).withColumn("line_id", F.lit(None).cast("bigint"))
    assert rows(Q.reason_counts(nameless, layout(spark))) == [("column_count", 1)]


_CELL = re.compile(r'"(?:[^"]|"")*"|[^",]*')


def parse(text):
    """The record read character by character: its cells, or None if the quoting is broken."""
    cells, at = [], 0
    while True:
        m = _CELL.match(text, at)
        at, cell = m.end(), m.group()
        if at < len(text) and text[at] != ",":
            return None
        cells.append(cell[1:-1].replace('""', '"') if cell[:1] == '"' else cell)
        if at == len(text):
            return cells
        at += 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet='",a \n\x01', max_size=14), min_size=40, max_size=40))
def test_cells_against_a_reader(spark, lines):
    got = {r["line_id"]: (r["quoting"], r["cells"]) for r in Q._parsed(frame(spark, lines)).collect()}
    for i, text in enumerate(lines):
        cells = parse(text)
        assert got[i] == (cells is not None, cells), text


def test_reader_agrees_with_csv():
    text = 'a,"b ""c"" d",,"e,f"'
    assert parse(text) == next(csv.reader(io.StringIO(text)))


@pytest.mark.parametrize("text", ["0.42000000", "1", "0.00000001", ".5", "-0.5"])
def test_amounts(spark, text):
    from decimal import Decimal

    from pyspark.sql import functions as F

    from ledgerloom.functions import cells as C

    assert spark.range(1).select(C.satoshis(F.lit(text)).alias("x")).first()["x"] == int(Decimal(text) * 100_000_000)
