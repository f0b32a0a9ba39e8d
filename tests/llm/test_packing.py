import random
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import packing as P
from tests.conftest import rows


def brute_best(counts, room):
    reach = {0}
    for length, n in counts.items():
        for _ in range(n):
            reach |= {s + length for s in reach if s + length <= room}
    return max(reach)


def test_best_fill_is_the_best():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 6) for _ in range(rng.randrange(1, 8))}
        room = rng.randrange(0, 90)
        fill = P.best_fill(counts, room)
        assert all(c <= counts[k] for k, c in fill.items())
        assert sum(k * c for k, c in fill.items()) == brute_best(counts, room)


def test_plan_uses_every_item_once():
    rng = random.Random(4)
    histogram = Counter(rng.randrange(1, 65) for _ in range(3000))
    used = Counter()
    for fill, times in P.plan(histogram, 64):
        assert sum(k * c for k, c in fill.items()) <= 64
        for k, c in fill.items():
            used[k] += c * times
    assert used == histogram


def check(sizes, packed, capacity):
    load, parts = Counter(), defaultdict(list)
    for doc, piece, start, n, container in packed:
        load[container] += n
        parts[doc].append((piece, start, n))
    assert all(v <= capacity for v in load.values())
    assert sorted(load) == list(range(len(load)))
    expected = {}
    for doc, n in sizes:
        if n:
            expected[doc] = [(i, i * capacity, min(capacity, n - i * capacity)) for i in range(-(-n // capacity))]
    assert {d: sorted(p) for d, p in parts.items()} == expected
    return len(load)


def test_pack(spark, monkeypatch):
    rng = random.Random(8)
    sizes = [(i, rng.choice([0, None, 1, 1, 1, rng.randrange(1, 120), rng.randrange(90, 400)])) for i in range(4000)]
    got = P.pack(spark.createDataFrame([(i, n, "x") for i, n in sizes], "doc_id bigint, n_tokens bigint, container_id string"), 100)
    containers = check(sizes, [tuple(r) for r in got.collect()], 100)
    bound = P.bound_report(got, 100).first()
    assert bound["containers"] == containers >= bound["least_containers"] and bound["unused"] == containers * 100 - sum(n or 0 for _, n in sizes)
    assert containers <= 1.01 * -(-sum(n or 0 for _, n in sizes) // 100) + 1
    again = P.pack(spark.createDataFrame(sizes[::-1], "doc_id bigint, n_tokens bigint").repartition(5), 100)
    assert rows(got) == rows(again)
    # a length that half the items have is numbered in lanes; the order is that of the hash all the same
    monkeypatch.setattr(P, "LANE_ITEMS", 100)
    assert rows(P.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), 100)) == rows(got)


@pytest.mark.parametrize("sizes", [[], [(1, 0), (2, None)], [(1, 100)], [(1, 101)], [(i, 60) for i in range(5)]])
def test_small_cases(spark, sizes):
    got = P.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), 100)
    check(sizes, [tuple(r) for r in got.collect()], 100)
