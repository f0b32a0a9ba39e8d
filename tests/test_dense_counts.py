import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom import skew
from ledgerloom.keys import clean_id
from ledgerloom.operators import dense_counts as D
from tests.conftest import rows

SCHEMA = "k string, item string, t bigint, n string"


def brute(data):
    out = defaultdict(lambda: [0, set(), []])
    for k, item, t, _ in data:
        k = None if k is None else k.strip(" ")
        if not k:
            continue
        out[k][0] += 1
        if item is not None:
            out[k][1].add(item)
        if t is not None:
            out[k][2].append(t)
    return sorted(((k, n, len(i), min(t, default=None), max(t, default=None)) for k, (n, i, t) in out.items()), key=str)


@pytest.mark.parametrize("limit", [skew.BROADCAST_ROWS, 0])
def test_counts_with_a_hot_key(spark, monkeypatch, limit):
    # with a limit of 0 the dictionary is shuffled and the hot key is salted
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.4 else f" k{rng.randrange(9000)} ", None if rng.random() < 0.05 else f"i{rng.randrange(300)}", None if rng.random() < 0.05 else rng.randrange(-50, 50), "x") for _ in range(20000)]
    data += [(None, "a", 1, None), ("  ", "a", 1, None), ("only-null", None, None, None)]
    got = D.per_key_counts(spark.createDataFrame(data, SCHEMA).repartition(7), clean_id("k"), F.col("item"), F.col("t"))
    assert rows(got, "key", "n", "items", "first", "last") == brute(data)


def test_empty(spark):
    assert rows(D.per_key_counts(spark.createDataFrame([], SCHEMA), clean_id("k"), F.col("item"))) == []


def test_heavy_keys_count_rows_without_a_key(spark):
    data = [("a", None, None, None)] * 2 + [(None, None, None, None)] * 97 + [("b", None, None, None)]
    got = D.heavy_keys(spark.createDataFrame(data, SCHEMA), clean_id("k"), 50)
    assert rows(got) == [("a", 2)]


def test_blocks_add_exactly_beyond_doubles():
    import numpy as np

    acc = D._Blocks()
    one = np.array([1 << 53, 1]), np.array([0, 0])
    acc.add(0, np.array([3, 3]), *one, np.array([5, 4]), np.array([5, 9]))
    assert [int(x[3]) for x in acc.live[0]] == [(1 << 53) + 1, 0, 4, 9]
