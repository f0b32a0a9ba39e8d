import itertools
import math

import numpy as np
import pytest

from ledgerloom import constants as K
from ledgerloom.operators import forest as R

NAMES = K.FEATURES[:4]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(160):
        x = rng.normal(size=len(K.FEATURES))
        out.append((f"E{i:03}", *map(float, x), int(x[0] + 0.5 * x[1] > 0.8)))
    return spark.createDataFrame(out, ["entity_id", *K.FEATURES, "label"]).cache()


def brute_shapley(paths, x):
    """The definition: for a set of known features, a tree's value with the unknown ones averaged by training weight."""

    def value(known):
        total = 0.0
        for tree in paths:
            for leaf in tree:
                w = leaf.value
                for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                    w *= float(low < x[f] <= high) if f in known else share
                total += w
        return total / len(paths)

    n = len(x)
    out = []
    for j in range(n):
        others = [k for k in range(n) if k != j]
        phi = 0.0
        for size in range(n):
            for s in itertools.combinations(others, size):
                phi += math.factorial(size) * math.factorial(n - 1 - size) / math.factorial(n) * (value({*s, j}) - value(set(s)))
        out.append(phi)
    return out


def test_forest_and_contributions(spark, labelled):
    model = R.fit(labelled, NAMES, trees=6)
    scored = {r["entity_id"]: (r["risk_score"], [r[n] for n in NAMES]) for r in R.predict(model, labelled, NAMES).collect()}
    assert all(0 <= s <= 1 for s, _ in scored.values())
    paths = R.export_paths(model)
    x = np.array([v for _, v in scored.values()])
    got = R.contributions(paths, x)
    base = sum(leaf.value * float(np.prod(leaf.share)) for tree in paths for leaf in tree) / len(paths)
    assert np.allclose(got.sum(1) + base, [s for s, _ in scored.values()], atol=1e-6)
    for i in (0, 7):
        assert np.allclose(got[i], brute_shapley(paths, x[i]), atol=1e-9)
    factors = {r["entity_id"]: r["factors"] for r in R.explain(model, labelled, NAMES, top=2).collect()}
    assert len(factors) == 160
    assert all(len(f) <= 2 and all(c["contribution"] >= 0 for c in f) and [c["contribution"] for c in f] == sorted((c["contribution"] for c in f), reverse=True) for f in factors.values())


def test_held_out_accuracy_and_null(labelled):
    true = R.metrics(labelled, names=NAMES, trees=20, k=3).first()
    assert true["n"] == 160 and true["f1"] > 0.7 and true["average_precision"] > 0.8
    null = R.metrics(R.shuffled_labels(labelled), names=NAMES, trees=20, k=3).first()
    assert null["average_precision"] < true["average_precision"] - 0.2


def test_folds_are_even(labelled):
    by = R.folds(labelled).groupBy("fold").count().collect()
    assert sum(r["count"] for r in by) == 160 and {r["fold"] for r in by} == set(range(K.FOLDS))


def test_isolation(spark):
    rng = np.random.default_rng(1)
    rows = [(f"E{i}", *map(float, rng.normal(size=2))) for i in range(300)] + [("odd", 9.0, -9.0), ("null", None, 0.0)]
    got = {r["entity_id"]: r for r in R.isolation_scores(spark.createDataFrame(rows, "entity_id string, a double, b double"), ["a", "b"], trees=60, sample=64, contamination=0.02).collect()}
    assert len(got) == 302
    assert max(got.values(), key=lambda r: r["anomaly_score"])["entity_id"] == "odd" and got["odd"]["is_anomaly"]
    assert 0 < sum(r["is_anomaly"] for r in got.values()) <= 7


def test_mean_path():
    assert R.mean_path(1) == 0 and R.mean_path(2) == 1
    assert abs(R.mean_path(256) - 10.244) < 0.01
