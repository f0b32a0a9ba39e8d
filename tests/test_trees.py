import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import constants as K
from ledgerloom.operators import forest as R
from ledgerloom.operators import trees as T

NAMES = ["a", "b", "c"]


def table(spark, n=80):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    return spark.createDataFrame([(f"E{i:03}", *map(float, r), int(r[0] + r[1] > 0.5)) for i, r in enumerate(x)], ["entity_id", *NAMES, "label"])


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_fit_is_three_jobs_whatever_its_trees(spark):
    rows = table(spark).cache()
    assert jobs(spark, "few", lambda: R.fit(rows, NAMES, 5)) <= 4
    assert jobs(spark, "many", lambda: R.fit(rows, NAMES, 60)) <= 4


def brute(codes, rows, weights, depth, leaf, left_by=0):
    """Nested (feature, bin, below, above) of the best cuts over drawn rows; a leaf is the class weights."""
    y = codes[rows, 0] // T.BINS
    have = np.bincount(y, minlength=2)
    best = None
    if left_by < depth and have.min():
        gini = lambda r: (lambda w: w[0] * w[1] / max(w.sum(), 1e-300))(np.bincount(codes[r, 0] // T.BINS, minlength=2) * weights)
        for f in range(codes.shape[1]):
            for b in range(T.BINS - 1):
                low = codes[rows, f] % T.BINS <= b
                if min(low.sum(), (~low).sum()) >= leaf:
                    after = gini(rows[low]) + gini(rows[~low])
                    if best is None or after < best[0] - 1e-9:
                        best = (after, f, b, low)
        if best and best[0] >= gini(rows) * (1 - 1e-9):
            best = None
    if best is None:
        return tuple(np.round(have * weights, 9))
    _, f, b, low = best
    return (f, b, brute(codes, rows[low], weights, depth, leaf, left_by + 1), brute(codes, rows[~low], weights, depth, leaf, left_by + 1))


def nested(nodes, i=0):
    n = nodes[i]
    return tuple(np.round(n["weight"], 9)) if n["feature"] < 0 else (int(n["feature"]), int(n["bin"]), nested(nodes, n["left"]), nested(nodes, n["right"]))


@pytest.mark.parametrize("seed", range(4))
def test_trees_against_every_cut(seed):
    rng = np.random.default_rng(seed)
    y = rng.random(90) < 0.3
    codes = (rng.integers(0, T.BINS, (90, 3)) + T.BINS * y[:, None]).astype(np.uint8)
    weights = np.array([0.7, 1.9])

    class AllFeaturesInOrder:
        def __init__(self):
            self.rng = np.random.default_rng(seed)

        def poisson(self, *a):
            return self.rng.poisson(*a)

        def random(self, shape):
            return np.broadcast_to(np.arange(shape[1]), shape)

    rows = np.repeat(np.arange(90), np.random.default_rng(seed).poisson(1.0, 90))
    assert nested(T.grow(codes, weights, AllFeaturesInOrder(), 4, 2, 3)) == brute(codes, rows, weights, 4, 2)


def test_rows_in_chunks_give_the_same_tree(monkeypatch):
    rng = np.random.default_rng(1)
    codes = (rng.integers(0, T.BINS, (300, 5)) + T.BINS * (rng.random((300, 1)) < 0.3)).astype(np.uint8)
    whole = T.grow(codes, np.ones(2), np.random.default_rng(2), 8, 2, 3)
    monkeypatch.setattr(T, "CHUNK", 7)
    assert (T.grow(codes, np.ones(2), np.random.default_rng(2), 8, 2, 3) == whole).all() and len(whole) > 20


def test_bins_part_rare_values_and_halve_even_ones():
    assert T.edges(np.array([0.0, 1.0, 4.0]), np.array([990, 5, 5])).tolist() == [0.5, 2.5]
    skewed = T.edges(np.arange(100.0), np.array([10**6, *[1] * 99]))
    assert len(skewed) > 20 and skewed[0] == 0.5
    even = T.edges(np.arange(3200.0), np.ones(3200))
    assert len(even) == T.BINS - 1 and np.allclose(np.diff(even), 100, atol=1)


def test_sums_keep_counts_and_ranks():
    value = np.random.default_rng(0).lognormal(size=20_000)
    v, c = T.summed(value, np.ones(20_000), T.POINTS)
    assert len(v) <= T.POINTS and c.sum() == 20_000 and (np.diff(v) > 0).all()
    assert np.abs(np.searchsorted(np.sort(value), v) - (np.cumsum(c) - c / 2)).max() < 20_000 / T.POINTS


def test_odd_rows(spark):
    rows = table(spark, 12)
    assert {r["risk_score"] for r in R.predict(R.fit(rows.where("false"), NAMES, 3), rows, NAMES).collect()} == {0.0}
    only = rows.withColumn("label", (rows["label"] * 0 + 1).cast("int"))
    got = R.predict(R.fit(only, NAMES, 3), rows.selectExpr("entity_id", "cast(null as double) as a", "double('nan') as b", "double('inf') as c"), NAMES).collect()
    assert len(got) == 12 and all(0 < r["risk_score"] <= 1 for r in got)


def test_importances_and_too_many_rows(spark, monkeypatch):
    rows = table(spark)
    got = {n: v for n, _, v in R.importances(R.fit(rows.withColumnsRenamed(dict(zip(NAMES, K.FEATURES))), K.FEATURES[:3], 20), K.FEATURES[:3])}
    assert abs(sum(got.values()) - 1) < 1e-9 and min(got, key=got.get) == K.FEATURES[2]
    monkeypatch.setattr(T, "MOST", 10)
    assert not isinstance(R.fit(rows, NAMES, 3), T.Forest)


def test_metrics_of_seeds_are_not_one_plan(spark):
    rows = table(spark, 30).withColumnsRenamed(dict(zip(NAMES, K.FEATURES))).select("*", *(F.lit(0.0).alias(n) for n in K.FEATURES[3:]))
    found = R.seed_stability(rows, [0, 1], trees=2, k=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Exchange", "Join")) and [r["n"] for r in found.collect()] == [30, 30]
