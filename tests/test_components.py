import random

import numpy as np
import pytest

from ledgerloom import skew
from ledgerloom.operators import components as C
from tests.conftest import rows


def brute(edges, vertices=()):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for v in vertices:
        root(v)
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in parent}


def test_local_union_find():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 500, 400), rng.integers(0, 500, 400)
    names, roots = C.union_find(u, v)
    assert dict(zip(names.tolist(), roots.tolist())) == brute(zip(u.tolist(), v.tolist()))


@pytest.mark.parametrize("piece", [C.PIECE, 50])
def test_labels_of_chains_and_hubs(spark, monkeypatch, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    monkeypatch.setattr(C, "CELL", 400)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(80)] + [(1000, i) for i in range(1001, 1700)] + [(rng.randrange(2000, 4000), rng.randrange(2000, 4000)) for _ in range(900)]
    rng.shuffle(edges)
    edges += edges[:20] + [(5, 5), (None, 3), (7, None)]
    got = dict(rows(C.component_labels(spark.createDataFrame(edges, "u bigint, v bigint"))))
    expected = {v: r for v, r in brute([e for e in edges if None not in e]).items() if v != r}
    assert got == expected


def test_a_path_whose_edges_all_lie_apart(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL", 1)
    rounds, write = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, label: rounds.append(label) or write(df, label))
    got = dict(rows(C.component_labels(spark.createDataFrame([(i, i + 1) for i in range(60)], "u bigint, v bigint"))))
    assert got == {i: 0 for i in range(1, 61)}
    assert rounds.count("met") <= 12


def test_no_edges(spark):
    assert rows(C.component_labels(spark.createDataFrame([], "u bigint, v bigint"))) == []


@pytest.mark.parametrize("limit", [skew.BROADCAST_ROWS, 0])
def test_address_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    clusters = [(" BC1QAb ", "C1", 1), ("3x", "C1 ", 2), ("3x", "C2", None), ("1y", "C2", 3), (None, "C2", 1), ("lone", None, 1), ("", "C9", 1), ("1z", "C7", 1), ("1z", "C7", 1)]
    entities = [("1z", "E1", "ignored", None), ("3w", " E1", None, None), ("solo", "E5", None, None), (None, "E1", None, None), ("blank", "  ", None, None)]
    got = C.address_groups(spark.createDataFrame(clusters, "address string, cluster_id string, cluster_size int"), spark.createDataFrame(entities, "address string, entity_id string, cluster_id string, group_address string"))
    assert rows(got, "address", "group_address") == sorted([("bc1qab", "1y"), ("3x", "1y"), ("1y", "1y"), ("lone", "lone"), ("1z", "1z"), ("3w", "1z"), ("solo", "solo"), ("blank", "blank")], key=str)


def test_address_groups_of_empty_tables(spark):
    got = C.address_groups(spark.createDataFrame([], "address string, cluster_id string"), spark.createDataFrame([], "address string, entity_id string"))
    assert rows(got) == []
