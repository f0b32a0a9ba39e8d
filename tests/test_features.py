import random
import statistics

from ledgerloom.operators import features, graph
from tests.conftest import rows


def test_medians_with_a_group_that_holds_half(spark):
    rng = random.Random(1)
    data = [("hot" if i % 2 else f"g{i % 9}", rng.choice([None, rng.randrange(50), rng.randrange(10**12)])) for i in range(3000)] + [("none", None), ("one", 4), ("two", 1), ("two", 2)]
    by = {}
    for g, v in data:
        if v is not None:
            by.setdefault(g, []).append(v)
    got = dict(rows(features.medians(spark.createDataFrame(data, "g string, v bigint"), "g", "v")))
    assert got == {g: statistics.median(v) for g, v in by.items()}


def test_reach_through_a_hub_and_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(2)
    edges = [("hub", f"n{i}") for i in range(300)] + [(f"n{rng.randrange(300)}", f"m{rng.randrange(200)}") for _ in range(300)] + [(None, "n1"), ("n2", None), ("far", "farther")]
    near = {}
    for a, b in edges:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    depth, fringe = {"m1": 0}, ["m1"]
    for d in (1, 2, 3):
        fringe = sorted({y for x in fringe for y in near.get(x, ())} - set(depth))
        depth |= dict.fromkeys(fringe, d)
    df, focus = spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([("m1",)], "id string")
    for limit in (graph.BROADCAST_FRINGE, 0):
        monkeypatch.setattr(graph, "BROADCAST_FRINGE", limit)
        assert dict(rows(graph.reach(df, focus, 3))) == depth
