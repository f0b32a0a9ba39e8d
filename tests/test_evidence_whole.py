import csv
import json

import pytest

from ledgerloom.sources import evidence as E
from ledgerloom.sources.ingest import ingest
from tests.test_evidence import RECORD, read


def csv_cells(txid, script="p2pkh"):
    return ["2026-08-01T00:00:00Z", "1.2.3.4", "1", "5.6.7.8", "8333", txid, "a;b", "c", "0.1;0.2", "0.3", "0.0001", script, "DE", "7"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_with_line_breaks_are_ingested(spark, tmp_path, end):
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator=end).writerows([E.FIELDS, csv_cells("t0"), csv_cells("t1", 'p2\n\n"sh"'), csv_cells("t2", "x,y"), csv_cells("t3", "\nz"), csv_cells("t4")])
    done = ingest(spark, [str(tmp_path / "a.csv")], str(tmp_path / "store"))
    assert (done.manifest["transactions"], done.manifest["observations"], done.manifest["rejected_records"]) == (5, 5, 0)
    assert {r["txid"]: r["script_type"] for r in done.tx.collect()} == {"t0": "p2pkh", "t1": 'p2\n\n"sh"', "t2": "x,y", "t3": "\nz", "t4": "p2pkh"}
    assert {r["txid"] for r in done.l2.collect()} == {f"t{i}" for i in range(5)}


def test_csv_without_line_breaks_in_quotes_stays_splittable(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([",".join(E.FIELDS), ",".join(csv_cells("t0", '"x,""y"""'))]) + "\n")
    assert not E._quotes_span_lines(spark, str(tmp_path / "a.csv"))
    assert read(spark, tmp_path / "a.csv")[0].first()["script_type"] == 'x,"y"'


def valid_txids(spark, path):
    got = read(spark, path)[0].orderBy("record_no").collect()
    return [r["txid"] if r["valid"] else None for r in got]


LINES = [json.dumps(RECORD | {"txid": f"t{i}"}) for i in range(3)]


@pytest.mark.parametrize("broken", ['{"txid": "a', '{"txid":', "{", '{"txid": "a",', "[", '[{"txid": "a"', '{"a": {}', "{broken}"])
def test_a_broken_first_line_loses_only_itself(spark, tmp_path, broken):
    (tmp_path / "a.jsonl").write_text("\n".join([broken, *LINES]) + "\n")
    assert valid_txids(spark, tmp_path / "a.jsonl") == [None, "t0", "t1", "t2"]


def test_documents_are_still_read_whole(spark, tmp_path):
    records = [json.loads(x) for x in LINES]
    for name, text, wanted in (
        ("pretty", json.dumps(records, indent=1), ["t0", "t1", "t2"]), ("flat", json.dumps(records), ["t0", "t1", "t2"]), ("one", json.dumps(records[0], indent=2), ["t0"]),
        ("nested", '{"extra": {"a": 1}\n, ' + LINES[0][1:], ["t0"]), ("blank", "\n\n" + json.dumps(records, indent=1) + "\n\n", ["t0", "t1", "t2"]),
    ):
        (tmp_path / f"{name}.json").write_text(text)
        assert valid_txids(spark, tmp_path / f"{name}.json") == wanted, name


def test_a_document_with_lines_behind_it_is_read_by_line(spark, tmp_path):
    (tmp_path / "a.json").write_text("{\n}\n" + LINES[0] + "\n")
    assert valid_txids(spark, tmp_path / "a.json") == [None, None, "t0"]
