from ledgerloom import constants as K
from ledgerloom.operators import forest as R
from ledgerloom.plans import reference

COLUMNS = ["entity_id", *K.FEATURES, "label"]


def labelled(spark, n=60):
    return spark.createDataFrame([(f"E{i:03}", *(float((i * (j + 3)) % 17) for j in range(len(K.FEATURES))), int(i % 4 == 0)) for i in range(n)], COLUMNS)


def test_registered_queries_run_the_whole_job(spark, monkeypatch):
    rows, fits = labelled(spark), []

    def fit(rows, names=K.FEATURES, trees=K.FOREST_TREES, seed=K.SEED):
        fits.append((len(names), trees, seed))
        return None

    monkeypatch.setattr(reference, "_labelled", lambda s, d: rows)
    monkeypatch.setattr(R, "fit", fit)
    monkeypatch.setattr(R, "predict", lambda model, rows, names=K.FEATURES: rows.selectExpr("*", "0.5D as risk_score"))
    one = [(len(K.FEATURES), 300, K.SEED)] * 5
    seeds = {"forest_metrics": 1, "forest_null": 3, "forest_stability": 8}
    for name, n in seeds.items():
        fits.clear()
        out = reference.QUERIES[name](spark, "").collect()
        assert fits == one * n
        assert [r["n"] for r in out] == [60] * (8 if name == "forest_stability" else 1)
    assert sorted(r["seed"] for r in out) == list(range(8))
    fits.clear()
    assert reference.QUERIES["forest_ablation"](spark, "").count() == len(K.FEATURE_GROUPS)
    widths = [sum(len(f) for f in list(K.FEATURE_GROUPS.values())[: i + 1]) for i in range(len(K.FEATURE_GROUPS))]
    assert fits == [(w, 300, K.SEED) for w in widths for _ in range(5)]


def test_seeds_give_other_folds(spark):
    by = [{r["entity_id"]: r["fold"] for r in R.folds(labelled(spark), seed=s).collect()} for s in (0, 1, 0)]
    assert by[0] == by[2] != by[1]


def test_null_is_the_mean_over_seeds(spark):
    rows = labelled(spark)
    each = R.seed_stability(R.shuffled_labels(rows), [0, 1], trees=3, k=2).collect()
    mean = R.label_null(rows, [0, 1], trees=3, k=2).first()
    for c in ("precision", "recall", "f1", "average_precision"):
        assert abs(mean[c] - sum(r[c] for r in each) / 2) < 1e-12
    assert mean["n"] == 60
