import random
from datetime import datetime, timedelta

from ledgerloom.operators import orphans as O
from tests.conftest import rows

EDGES = "id string, label string, source string, target string, loaded_at timestamp_ntz, ref_key string"
NODES = "id string, loaded_at timestamp_ntz, retired_at timestamp_ntz"
ENTITY = "entity_id string, loaded_at timestamp_ntz, period string"
OWNER = "entity_id string, loaded_at timestamp_ntz, retired_at timestamp_ntz"


def found(spark, edges, leads, scores, nodes, entities):
    make = spark.createDataFrame
    return rows(O.orphans(make(edges, EDGES), make(leads, ENTITY), make(scores, ENTITY), make(nodes, NODES), make(entities, OWNER)), "table_name", "field_name", "row_key", "ref_key", "load_month", "absence")


def brute(edges, leads, scores, nodes, entities):
    key = lambda x: (x or "").strip(" ") or None
    refs = [("graph_edges", f, key(e[0]), key(e[2 + i]), e[4], nodes) for e in edges for i, f in enumerate(("source", "target"))]
    refs += [(t, "entity_id", key(r[0]), key(r[0]), r[1], entities) for t, table in (("leads", leads), ("scores", scores)) for r in table]
    out = set()
    for t, f, rk, k, at, parents in refs:
        if k is None:
            continue
        own = [p for p in parents if key(p[0]) == k]
        if at is None:
            if not own:
                out.add((t, f, rk, k, None, "missing"))
            continue
        loaded = [p for p in own if p[1] is not None and p[1] <= at]
        if any(p[2] is None or p[2] > at for p in loaded):
            continue
        out.add((t, f, rk, k, at.strftime("%Y-%m"), "missing" if not own else "late" if not loaded else "deleted"))
    return sorted(out, key=str)


def test_random_histories(spark):
    rng = random.Random(11)
    when = lambda: None if rng.random() < 0.03 else datetime(2027, 1, 30) + timedelta(hours=rng.randrange(96), microseconds=rng.choice([0, 0, 1]))
    name = lambda: rng.choice([None, " ", "hot", "hot", "hot "] + [f"k{i}" for i in range(30)] + [f" k{i}" for i in range(30)])
    parents = lambda n: [(name(), t := when(), None if t is None or rng.random() < 0.4 else t + timedelta(hours=rng.randrange(60))) for _ in range(n)]
    edges = [(f"e{i % 180}", "x", name(), name(), when(), "z") for i in range(400)]
    edges += edges[:10]
    case = edges, [(name(), when(), "p") for _ in range(150)], [(name(), when(), None) for _ in range(80)], parents(40), parents(40)
    assert found(spark, *case) == brute(*case)


def test_bounds_of_validity(spark):
    day = datetime(2027, 3, 1)
    tick = timedelta(microseconds=1)
    nodes = [("a", day, day + timedelta(days=2)), ("b", day + timedelta(days=1), None)]
    edges = [("1", "x", "a", "b", day, None), ("2", "x", "a", "b", day + timedelta(days=2), None), ("3", "x", "a", None, day + timedelta(days=2) - tick, None), ("4", "x", "a", "c", day - tick, None)]
    assert found(spark, edges, [], [], nodes, []) == brute(edges, [], [], nodes, [])


def test_far_dates(spark):
    first, last = datetime(1970, 1, 1, 5), datetime(9999, 12, 30, 7)
    nodes = [("a", first, last), ("b", datetime(1900, 1, 1), None), ("c", last, None), ("d", datetime(2027, 1, 1), datetime(2027, 1, 3)), ("d", datetime(2027, 1, 2), last)]
    edges = [(f"{i}", "x", k, "b", t, None) for i, (k, t) in enumerate((k, t) for k in "abcde" for t in (first, datetime(2027, 1, 2, 3), last))]
    assert found(spark, edges, [], [], nodes, []) == brute(edges, [], [], nodes, [])


def test_a_key_with_half_of_the_references(spark):
    day = datetime(2027, 3, 1)
    nodes = [("hot", day + timedelta(hours=12), day + timedelta(hours=36)), ("k1", day, None)]
    edges = [(f"e{i}", "x", "hot", f"k{i % 3}", day + timedelta(minutes=7 * i), None) for i in range(600)]
    assert found(spark, edges, [], [], nodes, []) == brute(edges, [], [], nodes, [])


def test_empty_tables(spark):
    assert found(spark, [], [], [], [], []) == []
    day = datetime(2027, 3, 1)
    assert found(spark, [], [("E1", day, None)], [], [], []) == [("leads", "entity_id", "E1", "E1", "2027-03", "missing")]
