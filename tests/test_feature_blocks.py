from ledgerloom.operators import feature_blocks as B
from tests.conftest import rows

TX = "txid string, ts_micro bigint, input_addresses array<string>, script_type string, n_inputs bigint, n_outputs bigint, total_out bigint, fee bigint, extra string"


def long_of(spark, tx, entities):
    wide, n = B.entity_features(spark.createDataFrame(tx, TX), spark.createDataFrame(entities, "address string, entity_id string, retired_at string"))
    return wide, n, rows(B.long_features(wide, n), "entity_id", "event_type", "n", "last_ts", "last_txid", "total_out", "fee")


def test_events_by_entity_and_type(spark, monkeypatch):
    monkeypatch.setattr(B, "TYPES_PER_BLOCK", 1)
    tx = [
        ("t1", 5, [" BC1Qa "], "p2sh", 2, 3, 10, 1, "x"),
        ("t1", 5, [" BC1Qa "], "p2sh", 2, 3, 10, 1, "x"),  # a repeated row
        ("t2", 5, ["bc1qa", "zz"], "p2sh", 2, 3, None, None, "x"),  # a tie in time
        ("t3", 9, ["1b"], "p2pkh", 1, 1, None, 4, "x"),
        ("t4", None, ["1b"], "p2pkh", 1, 1, 7, 7, "x"),
        ("t5", 4, ["1b"], None, 1, 1, 7, 7, "x"),
        ("t6", 4, [], "p2pkh", 0, 1, 7, 7, "x"),
        ("t7", 4, None, "p2pkh", 0, 1, 7, 7, "x"),
        ("t8", 4, ["nobody"], "p2pkh", 1, 1, 7, 7, "x"),
        (None, 4, ["1b"], "p2pkh", 1, 1, 7, 7, "x"),
    ]
    entities = [("bc1qA", " E1", None), ("bc1qa", "E1", "gone"), ("1b ", "E2", "gone"), ("3c", "E3", None), ("4d", None, None), (None, "E1", None)]
    wide, n, got = long_of(spark, tx, entities)
    assert n == 3  # every type of the ledger has its place, also one without an entity
    assert got == sorted([("E1", "p2sh:2:3", 2, 5, "t2", 10, 1), ("E2", "p2pkh:1:1", 1, 9, "t3", None, 4)], key=str)
    assert rows(wide, "entity_id") == [("E1",), ("E2",), ("E3",)]


def test_a_busy_entity_and_more_types_than_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "TYPES_PER_BLOCK", 2)
    monkeypatch.setattr(B, "MAX_BLOCKS", 3)
    tx = [(f"t{i:04}", i % 97, ["hot" if i % 2 else f"a{i % 30}"], "p2sh", 1, i % 11, i, 1, None) for i in range(600)]
    wide, n, got = long_of(spark, tx, [("hot", "E", None)] + [(f"a{i}", f"E{i % 4}", None) for i in range(30)])
    assert n == 3 and wide.columns == ["entity_id", "block_0", "block_1", "block_2"]
    by = {}
    for txid, ts, (address,), script, n_in, n_out, out, fee, _ in tx:
        by.setdefault(("E" if address == "hot" else f"E{int(address[1:]) % 4}", f"{script}:{n_in}:{n_out}"), []).append((ts, txid, out, fee))
    assert got == sorted(((e, t, len(x), *max(x)[:2], sum(r[2] for r in x), sum(r[3] for r in x)) for (e, t), x in by.items()), key=str)


def test_empty_tables(spark):
    wide, n, got = long_of(spark, [], [])
    assert (n, got, wide.count()) == (1, [], 0)
    wide, _, got = long_of(spark, [], [("a", "E1", None)])
    assert (got, wide.count()) == ([], 1)
