import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.functions.stats import binomial_tail
from ledgerloom.operators import attribution, chains, change, cospend, entities, evaluation, graph, mixing
from tests.conftest import rows

TX = "txid string, ts_micro bigint, input_addresses array<string>, output_addresses array<string>, output_amounts array<bigint>, script_type string, n_inputs bigint, n_outputs bigint"


def tx(txid, at, ins, outs, amounts, script="p2pkh"):
    return (txid, at, ins, outs, amounts, script, len(ins or []), len(outs or []))


def frame(spark, txs):
    return spark.createDataFrame(txs, TX)


def test_mixing(spark):
    txs = [
        tx("a", 1, ["1", "2", "3"], list("wxyz"), [50_000_000, 7, 50_000_000, 50_000_000]),
        tx("b", 1, ["1", "2"], list("xyz"), [5, 5, 5]),
        tx("c", 1, ["1", "2", "3"], list("xyz"), [5, 6, 7]),
        tx("d", 1, ["1", "2", "3"], list("uvwxyz"), [9, 5, 5, 9, 9, 5]),
        tx("e", 1, [], [], []),
        tx("f", 1, None, None, None),
    ]
    got = {r["txid"]: r for r in mixing.classify(frame(spark, txs)).collect()}
    assert [got[k]["is_coinjoin"] for k in "abcdef"] == [True, False, False, True, False, False]
    assert got["a"]["coinjoin_reason"] == "3 outputs of 0.50000000 BTC across 3 inputs"
    assert (got["d"]["denomination"], got["c"]["equal_count"], got["b"]["equal_count"]) == (9, 1, 0)
    assert got["b"]["coinjoin_reason"] == "2 inputs, 3 outputs: too small"
    assert got["c"]["coinjoin_reason"] == "largest equal-value group is 1, need 3"


def brute_guesses(txs):
    seen, spent, out = set(), {}, {}
    timed = sorted((t for t in txs if t[1] is not None), key=lambda t: (t[1], t[0]))
    for t in timed:
        for a in t[2]:
            spent.setdefault(a, t[1])
    for t in timed:
        if len(t[3]) == 2:
            scores, ragged = [], []
            for a, s in zip(t[3], t[4]):
                script = next((name for p, name in K.SCRIPT_PREFIXES if a.startswith(p)), K.UNKNOWN_SCRIPT)
                parts = [K.WEIGHT_FRESH if a not in seen else 0.0, K.WEIGHT_RAGGED if s % K.ROUND_UNIT else 0.0, K.WEIGHT_SCRIPT if script == t[5] else 0.0, K.WEIGHT_SPENT_SOON if a in spent and 0 <= spent[a] - t[1] <= K.SPENT_SOON_MICROS else 0.0]
                scores.append(sum(parts))
                ragged.append(parts[1] > 0)
            best, margin = (0 if scores[0] >= scores[1] else 1), abs(scores[0] - scores[1])
            out[t[0]] = (best if margin >= K.MIN_MARGIN else None, margin, ragged[best])
        seen.update(t[2] + t[3])
    return {t[0]: out.get(t[0], (None, 0.0, False)) for t in txs}


def random_txs(seed, n=300):
    rng = random.Random(seed)
    address = lambda: rng.choice(["bc1q", "3", "1", "x"]) + str(rng.randrange(90))
    out = []
    for i in range(n):
        outs = [address() for _ in range(rng.choice([1, 2, 2, 2, 3]))]
        out.append(tx(f"t{i:03}", None if rng.random() < 0.02 else rng.randrange(10) * 40_000_000_000, [address() for _ in range(rng.randrange(0, 4))], outs, [rng.choice([100_000, 300_000, 123_456, 7]) for _ in outs], rng.choice(["p2pkh", "p2sh", "v0_p2wpkh"])))
    return out


def test_change_against_a_walk(spark):
    txs = random_txs(1)
    got = {r["txid"]: (r["change_index"], r["change_confidence"], r["change_corroborated"]) for r in change.guesses(frame(spark, txs)).collect()}
    assert got == brute_guesses(txs)


def test_cospend_groups(spark):
    txs = random_txs(2, 120)
    df = frame(spark, txs)
    flags = mixing.classify(df)
    mixed = {r["txid"] for r in flags.where("is_coinjoin").collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for t in txs:
        for a in t[2] + t[3]:
            root(a)
        if t[0] not in mixed:
            for a in t[2][1:]:
                x, y = sorted((root(t[2][0]), root(a)))
                parent[y] = x
    assert dict(rows(cospend.cospend_groups(df, flags))) == {a: root(a) for a in parent}


@pytest.mark.parametrize(("confidence", "size", "merged"), [(0.69, 6, True), (0.69, 7, False), (0.75, 7, True), (0.39, 1, False)])
def test_merge_budget(spark, confidence, size, merged):
    left, right = [f"a{i}" for i in range(10)], [f"b{i}" for i in range(size)]
    groups = spark.createDataFrame([(x, "a0") for x in left] + [(x, "b0") for x in right], "address string, `group` string")
    made = spark.createDataFrame([("t", 1, ["a3"])], "txid string, ts_micro bigint, input_addresses array<string>")
    flags = spark.createDataFrame([("t", False, "b0", confidence, True)], "txid string, is_coinjoin boolean, change_address string, change_confidence double, change_corroborated boolean")
    assert {g for _, g in rows(cospend.budgeted_merge(made, flags, groups))} == ({"a0"} if merged else {"a0", "b0"})


def chain_txs(prefix, hops, start=0):
    return [tx(f"{prefix}{i:02}", start + i, [f"{prefix}addr{i}"], [f"{prefix}pay{i}", f"{prefix}addr{i + 1}"], [4, 96]) for i in range(hops)]


def test_chains(spark):
    txs = chain_txs("a", 9) + chain_txs("b", 3) + chain_txs("c", 4, 100)
    txs += [tx("d0", 1, ["d0"], ["p", "d1"], [1, 9]), tx("d1", 2, ["d1"], ["p", "d2"], [1, 9]), tx("d2", 3, ["d2"], ["p", "d0"], [1, 9])]  # a cycle has no start
    txs += [tx("e0", 0, ["e"], ["p", "d0"], [1, 9])]  # a walk that runs into the cycle
    txs += [tx("f0", 0, ["f0"], ["q", "f1"], [4, 6]), tx("f1", 1, ["f1"], ["q", "f2"], [1, 9])]  # too even a split
    got = chains.detect(frame(spark, txs)).collect()
    by = {}
    for r in got:
        by.setdefault(r["start"], []).append(r)
    assert {s: [r["txid"] for r in sorted(c, key=lambda r: r["hop"])] for s, c in by.items()} == {"a00": [f"a{i:02}" for i in range(9)], "c00": [f"c{i:02}" for i in range(4)], "e0": ["e0", "d0", "d1", "d2"]}
    a = sorted(by["a00"], key=lambda r: r["hop"])
    assert (a[0]["hops"], a[0]["peeled_sats"], a[0]["median_peel"], a[0]["laundering_like"], a[0]["chain_id"]) == (9, 36, 0.04, True, "CH-a00")
    assert [r["carried_address"] for r in a] == [f"aaddr{i}" for i in range(1, 9)] + [None]
    assert not by["c00"][0]["laundering_like"]
    assert len(rows(chains.consecutive(chains.detect(frame(spark, txs))))) == 8 + 3 + 3
    assert rows(chains.detect(frame(spark, []))) == []


def test_folding(spark):
    groups = spark.createDataFrame([(f"aaddr{i}", f"g{i % 3}") for i in range(1, 5)] + [("other", "g9")], "address string, `group` string")
    folded = entities.fold(groups, chains.detect(frame(spark, chain_txs("a", 5))))
    assert {r["address"]: r["entity"] for r in folded.collect()} == {"aaddr1": "g0", "aaddr2": "g0", "aaddr3": "g0", "aaddr4": "g0", "other": "g9"}
    assert rows(entities.newly_merged(folded)) == [(2,)]


@pytest.mark.parametrize(("k", "n", "p"), [(0, 5, 0.3), (-1, 5, 0.3), (3, 10, 0.0), (3, 10, 1.0), (6, 5, 0.3), (1, 1, 0.25), (30, 37, 0.01), (2, 40, 0.5), (25, 40, 0.5), (380, 800, 0.4), (310, 800, 0.4), (5, 900, 0.0001), (9, 900, 0.001)])
def test_binomial_tail(spark, k, n, p):
    got = spark.range(1).select(binomial_tail(F.lit(k), F.lit(n), F.lit(p)).alias("x")).first()["x"]
    if k <= 0 or p >= 1:
        expected = 1.0
    elif p <= 0 or k > n:
        expected = 0.0
    else:
        q = Fraction(str(p))
        a, b = q.numerator, q.denominator
        expected = float(Fraction(sum(math.comb(n, i) * a**i * (b - a) ** (n - i) for i in range(k, n + 1)), b**n))
    assert got == pytest.approx(expected, rel=1e-9, abs=1e-300)


def test_attribution_finds_the_origin(spark):
    rng = random.Random(4)
    seen, of = [], []
    for e in range(12):
        for t in range(14):
            txid = f"e{e}t{t:02}"
            of.append((txid, f"E{e}"))
            first = f"10.0.0.{e}" if rng.random() < 0.7 else f"10.9.0.{rng.randrange(40)}"
            seen += [(txid, first, 1, 1, "DE"), (txid, f"10.9.0.{rng.randrange(40)}", 2, 2, None)]
    s = spark.createDataFrame(seen, "txid string, src_ip string, arrival_rank bigint, asn bigint, country string")
    o = spark.createDataFrame(of, "txid string, entity_id string")
    best = {r["entity_id"]: r for r in attribution.best_per_entity(attribution.leads(s, o)).collect()}
    assert {e: r["ip"] for e, r in best.items() if r["significant"]} == {f"E{e}": f"10.0.0.{e}" for e in range(12)}
    null = attribution.leads(s, attribution.shuffled_owners(o, 1))
    assert null.where("significant").count() <= 2
    assert attribution.shuffled_owners(o, 1).groupBy("entity_id").count().where("count = 14").count() == 12
    assert rows(attribution.leads(s.where("false"), o)) == []


def test_reach_and_integrity(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "c", "b"), ("e3", "c", "d"), ("e4", "x", None), ("e4", "x", None)], "id string, source string, target string")
    focus = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.reach(edges, focus, 2)) == [("a", 0), ("b", 1), ("c", 2)]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "id string")
    assert rows(graph.dangling_edges(nodes, edges), "id") == [("e3",), ("e4",)]


def test_average_precision(spark):
    data = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1), (None, 1), (0.5, None)]
    r = evaluation.classification(spark.createDataFrame(data, "s double, y int"), "s", "y").first()
    assert r["average_precision"] == pytest.approx((1 * 1 + 2 / 3 * 1 + 3 / 5 * 1) / 3)
    assert (r["precision"], r["recall"], r["n"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 5)
