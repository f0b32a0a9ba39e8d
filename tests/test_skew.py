import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import skew
from tests.conftest import rows


@pytest.mark.parametrize("limit", [skew.BROADCAST_ROWS, 0])
def test_lookup_with_hot_and_null_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    rng = random.Random(3)
    left = [(rng.choice(["hot"] * 6 + [None] + [f"k{i}" for i in range(40)]), i) for i in range(3000)]
    right = {"hot": 1} | {f"k{i}": i + 10 for i in range(0, 40, 2)}
    got = skew.lookup(spark.createDataFrame(left, "k string, i int"), "k", spark.createDataFrame(list(right.items()), "k string, v bigint"), len(right), "v")
    assert got.columns == ["k", "i", "v"]
    assert rows(got) == sorted(((k, i, right.get(k)) for k, i in left), key=str)


def test_long_keys_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1000)
    short, long_ = (spark.createDataFrame([("x" * n + str(i), i) for i in range(10)], "k string, v bigint") for n in (10, 1000))
    assert skew.is_small(short, 10) and not skew.is_small(long_, 10)
    assert skew.is_small(long_.select("v"), 10) and not skew.is_small(short, skew.BROADCAST_ROWS + 1)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_groups_with_a_hot_key(spark, limit):
    left = [(7 if i % 2 else i, i) for i in range(2000)]
    df = spark.createDataFrame(left, "k bigint, i int")
    groups = skew.materialize(df.groupBy("k").agg(F.count("*").alias("n")).where("n > 1 or k < 100"), "groups")
    assert rows(skew.join_groups(df, groups, ["k"], limit).select("k", "i", "n")) == sorted(((k, i, 1000 if k == 7 else 1) for k, i in left if k < 100), key=str)


def test_dealing_keeps_values_and_does_not_depend_on_lanes(spark):
    df = spark.createDataFrame([(f"t{i}", f"e{i % 7}") for i in range(500)], "t string, e string")
    one, two = (rows(skew.dealt(df, "t", "e", 5, lanes=n)) for n in (3, 64))
    assert one == two != rows(df)
    assert sorted(e for _, e in one) == sorted(f"e{i % 7}" for i in range(500))
