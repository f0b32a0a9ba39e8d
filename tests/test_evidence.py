import json

import pytest

from ledgerloom.operators import observations as O
from ledgerloom.sources import evidence as E
from ledgerloom.sources import generator as G
from ledgerloom.sources.files import hashes
from ledgerloom.sources.ingest import ingest
from tests.conftest import rows

RECORD = dict(zip(E.FIELDS, ["2026-08-01T00:00:00.000481Z", "203.0.113.44", 41234, "192.0.2.1", 8333, "ab", ["bc1qa", "bc1qb"], ["1c"], ["0.1", ".5"], ["0.59"], "0.00002500", "p2pkh", "IN", 64512]))


def read(spark, *paths):
    raw, failed = E.read_evidence(spark, [str(p) for p in paths])
    return E.validated(raw), failed


@pytest.fixture
def written(tmp_path):
    records = [RECORD | {"txid": f"t{i}", "input_amounts": [f"0.{i}"] * 2} for i in range(5)]
    for name, write in (("json", G.write_json), ("csv", G.write_csv), ("xml", G.write_xml)):
        write(records, str(tmp_path / f"a.{name}"))
    return tmp_path


def test_three_formats_agree(spark, written):
    cols = ["txid", "ts_micro", "src_ip", "src_port", "dst_port", "input_addresses", "input_amounts", "output_amounts", "fee", "script_type", "geo_country", "asn", "valid"]
    parts = [rows(read(spark, written / f"a.{n}")[0], *cols) for n in ("json", "csv", "xml")]
    assert parts[0] == parts[1] == parts[2] and len(parts[0]) == 5
    assert parts[0][1][:5] == ("t1", 1785542400000481, "203.0.113.44", 41234, 8333)
    assert all(r[-1] for r in parts[0])


def test_csv_rejects(spark, tmp_path):
    p = tmp_path / "a.csv"
    good = "2026-08-01T00:00:00Z,1.2.3.4,,5.6.7.8,8333,ab,a;b,c,0.1;0.2,0.3,0.0001,p2sh,DE,x"
    cells = good.split(",")
    bad = [cells[:10] + [""] + cells[11:], cells[:2] + ["70000"] + cells[3:], cells[:8] + ["0.123456789"] + cells[9:], ["2026-13-01T00:00:00Z", *cells[1:]], [*cells[:5], "", *cells[6:]], [*cells, "ragged"]]
    p.write_text("\n".join([",".join(E.FIELDS), good, *(",".join(b) for b in bad)]) + "\n")
    got = read(spark, p)[0]
    assert sorted(r["valid"] for r in got.collect()) == [False] * 6 + [True]
    ok = got.where("valid").first()
    assert (ok["src_port"], ok["asn"], ok["fee"]) == (0, 0, 10_000)


def test_failing_files_do_not_end_the_run(spark, written):
    (written / "short.csv").write_text("timestamp,src_ip\nx,y\n")
    (written / "a.bin").write_text("x")
    got, failed = read(spark, written / "a.csv", written / "short.csv", written / "a.bin")
    assert got.count() == 5
    assert "missing column" in failed[str(written / "short.csv")] and failed[str(written / "a.bin")] == "unsupported extension"


def test_json_lines_and_broken_ones(spark, tmp_path):
    lines = [json.dumps(RECORD), "{broken", json.dumps({"timestamp": RECORD["timestamp"], "txid": "b"}), json.dumps(RECORD | {"fee": 0.5, "input_amounts": [1, "0.25"]})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    got = read(spark, tmp_path / "a.jsonl")[0].orderBy("record_no").collect()
    assert [r["valid"] for r in got] == [True, False, True, True]
    assert (got[2]["fee"], got[2]["input_addresses"], got[2]["src_port"]) == (0, [], 0)
    assert (got[3]["fee"], got[3]["input_amounts"]) == (50_000_000, [100_000_000, 25_000_000])
    (tmp_path / "one.json").write_text(json.dumps(RECORD, indent=2))
    assert [r["valid"] for r in read(spark, tmp_path / "one.json")[0].collect()] == [True]


def test_truncated_xml_keeps_what_precedes(spark, written):
    text = (written / "a.xml").read_text()
    (written / "cut.xml").write_text(text[: text.rindex("<observation>") + 60])
    got = read(spark, written / "cut.xml")[0].collect()
    assert sum(r["valid"] for r in got) == 4 and len(got) == 5


@pytest.mark.parametrize(
    ("text", "micros"),
    [("1970-01-01T00:00:00Z", 0), ("2026-08-01T00:00:00Z", 1785542400000000), ("2026-08-01T00:00:00+05:30", 1785542400000000), ("2026-08-01T00:00:00.1234567-05:00", 1785542400123456), ("1970-02-31T00:00Z", 61 * 86_400_000_000 - 86_400_000_000 * 0)]
    + [(t, None) for t in ("", "2026-08-01", "2026-13-01T00:00:00Z", "2026-08-01T00:00:00.abcZ")],
)
def test_evidence_timestamps(spark, text, micros):
    from pyspark.sql import functions as F

    from ledgerloom.functions.cells import evidence_micros

    assert spark.range(1).select(evidence_micros(F.lit(text)).alias("x")).first()["x"] == micros


def test_ingest(spark, written, tmp_path):
    paths = [str(written / f"a.{n}") for n in ("json", "csv", "xml")]
    known = spark.createDataFrame([("203.0.113.0/24", "XX", None, None), ("203.0.113.32/27", None, 7, "Org")], "cidr string, country string, asn bigint, asn_org string")
    done = ingest(spark, paths, str(tmp_path / "store"), known, str(tmp_path / "store/m/manifest.json"))
    m = json.loads((tmp_path / "store/m/manifest.json").read_text())
    assert (m["transactions"], m["observations"], m["rejected_records"], m["duplicate_records"], m["geo_from_database"]) == (5, 5, 0, 10, 5)
    import hashlib

    assert [s["sha256"] for s in m["sources"]] == [hashlib.sha256((written / f"a.{n}").read_bytes()).hexdigest() for n in ("csv", "json", "xml")]
    assert hashes(spark, paths[:1])[0]["bytes"] == (written / "a.json").stat().st_size
    row = done.l2.first()
    assert (row["geo_country"], row["asn"], row["asn_org"], row["country_source"], row["asn_source"], row["arrival_rank"]) == ("XX", 7, "Org", "db", "db", 1)
    assert done.tx.orderBy("txid").first()["total_out"] == 59_000_000
    assert O.conservation(done.tx).count() == 5  # inputs of this fixture do not add up
    (tmp_path / "none.csv").write_text(",".join(E.FIELDS) + "\n")
    with pytest.raises(ValueError, match="no valid record"):
        ingest(spark, [str(tmp_path / "none.csv")], str(tmp_path / "nothing"))
