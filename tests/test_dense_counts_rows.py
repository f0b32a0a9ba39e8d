import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import skew
from ledgerloom.keys import clean_id
from ledgerloom.operators import dense_counts as D
from tests.conftest import rows
from tests.test_dense_counts import SCHEMA, brute


@pytest.mark.parametrize("limit", [skew.BROADCAST_ROWS, 0])
def test_without_items_the_rows_themselves_are_counted(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    written, keep = {}, D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, label: written.setdefault(label, keep(df, label)))
    rng = random.Random(6)
    data = [("hot" if rng.random() < 0.4 else f" k{rng.randrange(5000)} ", None, None if rng.random() < 0.05 else rng.randrange(-50, 50), "x") for _ in range(12000)] + [(None, None, 1, None), ("  ", None, 1, None)]
    got = D.per_key_counts(spark.createDataFrame(data, SCHEMA).repartition(5), clean_id("k"), None, F.col("t"))
    assert rows(got, "key", "n", "items", "first", "last") == brute(data)
    assert written["pairs"].count() == 12000  # nothing counted them before
