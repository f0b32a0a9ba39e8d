"""Risk models: a balanced random forest, an isolation forest and the contributions behind a score.

Features come as one row per entity (``features.extract``), labels as 0 or 1.  The forest is grown by ``trees``, by Spark ML
where its rows are too many to be broadcast as codes; isolation trees are grown on samples of a fixed size, broadcast (their size does not grow with the rows) and scored by
Arrow batches; contributions are worked out over the forest's exported nodes in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .. import constants as K
from ..shared import materialize, shared_dir
from ..skew import dealt
from . import evaluation
from . import trees as T
from .features import group_of


def with_weights(rows: DataFrame) -> DataFrame:
    """Labelled rows with a weight that makes both classes count the same."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, F.lit(total / (len(counts) * n))).otherwise(weight)
    return rows.withColumn("weight", weight)


def assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows)


def fit(rows: DataFrame, names: list[str] = K.FEATURES, trees: int = K.FOREST_TREES, seed: int = K.SEED) -> T.Forest | RandomForestClassificationModel:
    """A forest on rows with the features ``names`` and a 0/1 label; without a labelled row it scores 0."""
    table = rows.where("label is not null").select(T.values(names), F.col("label").cast("int").alias("label"))
    classes, bounds = T.survey(table, len(names))
    if classes.sum() * len(names) <= T.MOST:
        return T.forest(table, len(names), classes, bounds, trees, K.FOREST_DEPTH, K.FOREST_LEAF, seed)
    return fit_ml(rows, names, trees, seed)


def fit_ml(rows: DataFrame, names: list[str] = K.FEATURES, trees: int = K.FOREST_TREES, seed: int = K.SEED) -> RandomForestClassificationModel:
    """The forest by Spark ML, which passes over the rows for each level of some trees."""
    classifier = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=K.FOREST_DEPTH, minInstancesPerNode=K.FOREST_LEAF, seed=seed, probabilityCol="probability")
    return classifier.fit(assembled(with_weights(rows.where("label is not null").withColumn("label", F.col("label").cast("double"))), names))


def predict(model: T.Forest | RandomForestClassificationModel, rows: DataFrame, names: list[str] = K.FEATURES) -> DataFrame:
    """``rows`` with risk_score, the probability of label 1."""
    if isinstance(model, T.Forest):
        sent = rows.sparkSession.sparkContext.broadcast(model)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept = b.drop_columns(["x"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sent.value.scores(T.matrix(b)))], names=[*kept.schema.names, "risk_score"])

        return rows.select("*", T.values(names)).mapInArrow(score, StructType([*rows.schema.fields, StructField("risk_score", DoubleType())]))
    return model.transform(assembled(rows, names)).withColumn("risk_score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def folds(rows: DataFrame, k: int = K.FOLDS, seed: int = K.SEED) -> DataFrame:
    """Labelled rows with a fold 0..k-1, the labels spread evenly over the folds; another seed gives other folds."""
    w = Window.partitionBy("label", "_lane").orderBy("_hash", "entity_id")
    laned = rows.withColumn("_hash", F.xxhash64("entity_id", F.lit(seed))).withColumn("_lane", F.pmod("_hash", F.lit(64)))
    # lanes begin at different folds, so short lanes do not all fill the first
    return laned.withColumn("fold", F.pmod(F.row_number().over(w) + F.col("_lane"), F.lit(k))).drop("_hash", "_lane")


def cross_validated(rows: DataFrame, names: list[str] = K.FEATURES, trees: int = K.FOREST_TREES, k: int = K.FOLDS, seed: int = K.SEED, fold_seed: int = K.SEED) -> DataFrame:
    """(entity_id, label, risk_score) where each row is scored by the forest that did not see its fold."""
    split = materialize(folds(rows.where("label is not null"), k, fold_seed), "folds")
    parts = []
    for i in range(k):
        model = fit(split.where(F.col("fold") != i), names, trees, seed)
        parts.append(predict(model, split.where(F.col("fold") == i), names).select("entity_id", "label", "risk_score"))
    return materialize(reduce(DataFrame.unionByName, parts), "pooled")


def metrics(rows: DataFrame, **options) -> DataFrame:
    """One row of pooled cross-validation metrics, written, so that a union of them is no plan of all their windows and joins at once."""
    return materialize(evaluation.classification(cross_validated(rows, **options), "risk_score", "label"), "metrics")


def ablation(rows: DataFrame, trees: int = K.FOREST_TREES, k: int = K.FOLDS) -> DataFrame:
    """Metrics as the groups of features are added one by one: groups, then the columns of ``metrics``."""
    names, parts = [], []
    for group, features in K.FEATURE_GROUPS.items():
        names = names + features
        parts.append(metrics(rows, names=list(names), trees=trees, k=k).withColumn("n_features", F.lit(len(names))).withColumn("last_group", F.lit(group)))
    return reduce(DataFrame.unionByName, parts)


def shuffled_labels(rows: DataFrame, seed: int = K.SEED) -> DataFrame:
    """The negative control: labels dealt to other rows, as many of each as before."""
    known = rows.where("label is not null")
    return known.drop("label").join(dealt(known, "entity_id", "label", seed), "entity_id")


def seed_stability(rows: DataFrame, seeds: list[int] = K.STABILITY_SEEDS, trees: int = K.FOREST_TREES, k: int = K.FOLDS) -> DataFrame:
    """Metrics for each seed of the folds; the forest's own seed stays."""
    return reduce(DataFrame.unionByName, (metrics(rows, trees=trees, k=k, fold_seed=s).withColumn("seed", F.lit(s)) for s in seeds))


def label_null(rows: DataFrame, seeds: list[int] = K.NULL_SEEDS, trees: int = K.FOREST_TREES, k: int = K.FOLDS) -> DataFrame:
    """One row of metrics with the labels dealt to other rows, each the mean over the seeds of the folds."""
    each = seed_stability(materialize(shuffled_labels(rows), "shuffled"), seeds, trees, k).drop("seed")
    return each.agg(*(F.avg(c).cast(t).alias(c) for c, t in each.dtypes))


def importances(model: T.Forest | RandomForestClassificationModel, names: list[str] = K.FEATURES) -> list[tuple[str, str, float]]:
    """(feature, group, importance), greatest first."""
    values = model.importances(len(names)) if isinstance(model, T.Forest) else model.featureImportances.toArray()
    return sorted(((n, group_of(n), float(v)) for n, v in zip(names, values)), key=lambda x: (-x[2], x[0]))


# isolation forest


@dataclass
class IsolationTree:
    """Nodes in arrays; a leaf has feature -1 and its path length in ``value``."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def lengths(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at]
            rows, node = np.flatnonzero(inner), at[inner]
            below = x[rows, self.feature[node]] < self.value[node]
            at[rows] = np.where(below, self.left[node], self.right[node])


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + float(np.euler_gamma)) - 2.0 * (n - 1) / n


def isolation_tree(x: np.ndarray, rng: np.random.Generator) -> IsolationTree:
    """One tree on a sample: random feature among those that vary, random cut between its least and greatest value."""
    depth_limit = math.ceil(math.log2(max(2, len(x))))
    nodes: list[list[float]] = []

    def grow(part: np.ndarray, depth: int) -> int:
        here = len(nodes)
        nodes.append([-1, depth + mean_path(len(part)), -1, -1])
        low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(0), np.zeros(0))
        varied = np.flatnonzero(low < high)
        if depth < depth_limit and len(part) > 1 and len(varied):
            f = int(rng.choice(varied))
            cut = rng.uniform(low[f], high[f])
            cut = cut if cut > low[f] else high[f]
            below = part[:, f] < cut
            nodes[here] = [f, cut, grow(part[below], depth + 1), grow(part[~below], depth + 1)]
        return here

    grow(x, 0)
    f, v, left, right = zip(*nodes)
    return IsolationTree(np.array(f, np.int64), np.array(v, float), np.array(left, np.int64), np.array(right, np.int64))


def isolation_scores(rows: DataFrame, names: list[str] = K.FEATURES, trees: int = K.ISOLATION_TREES, sample: int = K.ISOLATION_SAMPLE, contamination: float = K.CONTAMINATION, seed: int = K.SEED) -> DataFrame:
    """(entity_id, anomaly_score, is_anomaly): scores in (0, 1], the highest ``contamination`` of them flagged.

    Trees are fitted on at most ``sample`` x ``trees`` rows, drawn by a hash of the entity, ``sample`` rows a tree; every
    row is scored.  The cut is the exact percentile.  Nulls count as 0.
    """
    spark = rows.sparkSession
    table = rows.select("entity_id", F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names)).alias("x"))
    drawn = table.orderBy(F.xxhash64("entity_id", F.lit(seed))).limit(sample * trees).collect()
    rng = np.random.default_rng(seed)
    pool = np.array([r["x"] for r in drawn], float).reshape(-1, len(names))
    size = min(sample, len(pool))
    grown = [isolation_tree(pool[rng.choice(len(pool), size, replace=False)], rng) for _ in range(trees)] if size else []
    sent, scale = spark.sparkContext.broadcast(grown), mean_path(size) or 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["x"].flatten().to_numpy().reshape(b.num_rows, -1)
            mean = np.mean([t.lengths(x) for t in sent.value], axis=0)
            yield pa.RecordBatch.from_arrays([b["entity_id"], pa.array(np.power(2.0, -mean / scale))], names=["entity_id", "anomaly_score"])

    scored = materialize(table.mapInArrow(score, "entity_id string, anomaly_score double"), "isolation")
    cut = scored.agg(F.percentile("anomaly_score", 1 - contamination).alias("cut")).first()["cut"]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(cut if cut is not None else 1.0))


# contributions


@dataclass
class Path:
    """One leaf: features on the way with bounds and shares of the training weight, and the leaf's probability."""

    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def export_paths(model: T.Forest | RandomForestClassificationModel) -> list[list[Path]]:
    """The leaves of each tree of a forest (bounded by its trees and depth), one of Spark ML's read from the written model."""
    if isinstance(model, T.Forest):
        return [_leaves(t) for t in model.as_rows()]
    spark = SparkSession.active()
    folder = f"{shared_dir(spark)}/forest-{model.uid}"
    model.write().overwrite().save(folder)
    nodes: dict[int, dict[int, object]] = {}
    data = spark.read.parquet(f"{folder}/data")
    flat = data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data
    for r in flat.collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    return [_leaves(nodes[t]) for t in sorted(nodes)]


def _leaves(tree: dict) -> list[Path]:
    out = []
    weight = lambda n: float(sum(n["impurityStats"]))

    def walk(node, steps: list[tuple[int, float, float, float]]) -> None:
        if node["leftChild"] < 0:
            merged: dict[int, list[float]] = {}
            for f, low, high, share in steps:
                m = merged.setdefault(f, [-math.inf, math.inf, 1.0])
                m[0], m[1], m[2] = max(m[0], low), min(m[1], high), m[2] * share
            stats = node["impurityStats"]
            value = stats[1] / sum(stats) if sum(stats) else 0.0
            out.append(Path(list(merged), *(np.array([m[i] for m in merged.values()]) for i in range(3)), value))
            return
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        left, right = tree[node["leftChild"]], tree[node["rightChild"]]
        total = weight(node) or 1.0
        walk(left, [*steps, (f, -math.inf, cut, weight(left) / total)])
        walk(right, [*steps, (f, cut, math.inf, weight(right) / total)])

    walk(tree[0], [])
    return out


def contributions(paths: list[list[Path]], x: np.ndarray) -> np.ndarray:
    """Shapley values (path-dependent) of the mean of the trees, for rows x features.

    For a leaf whose way holds d features, feature j adds (o_j - z_j) times the leaf's value times the sum over subsets of
    the others, weighted by their size, of the product of o over the subset and z over the rest; o says whether the row goes
    the leaf's way at a feature, z is the share of training weight that does.  The sum is a polynomial by subset size.
    """
    out = np.zeros(x.shape)
    for leaf in (p for tree in paths for p in tree):
        d = len(leaf.features)
        if not d or not leaf.value:
            continue
        ones = ((x[:, leaf.features] > leaf.low) & (x[:, leaf.features] <= leaf.high)).astype(float)
        weights = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
        for j in range(d):
            poly = [np.ones(len(x))]
            for k in range(d):
                if k != j:
                    o, z = ones[:, k], leaf.share[k]
                    poly = [(poly[s] * z if s < len(poly) else 0.0) + (poly[s - 1] * o if s else 0.0) for s in range(len(poly) + 1)]
            out[:, leaf.features[j]] += leaf.value * (ones[:, j] - leaf.share[j]) * sum(w * p for w, p in zip(weights, poly))
    return out / max(1, len(paths))


def explain(model: RandomForestClassificationModel, rows: DataFrame, names: list[str] = K.FEATURES, top: int = K.TOP_FACTORS) -> DataFrame:
    """(entity_id, factors): the ``top`` features with the greatest positive contributions, rounded to 4 places."""
    sent = rows.sparkSession.sparkContext.broadcast(export_paths(model))
    table = rows.select("entity_id", F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names)).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = contributions(sent.value, b["x"].flatten().to_numpy().reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b["entity_id"], pa.array(list(c), pa.list_(pa.float64()))], names=["entity_id", "c"])

    found = table.mapInArrow(run, "entity_id string, c array<double>")
    named = F.array(*(F.struct(F.get("c", F.lit(i)).alias("contribution"), F.lit(n).alias("name"), F.lit(group_of(n)).alias("group")) for i, n in enumerate(names)))
    best = F.slice(F.filter(F.sort_array(named, asc=False), lambda x: x["contribution"] > 0), 1, top)
    return found.select("entity_id", F.transform(best, lambda x: F.struct(x["name"].alias("name"), x["group"].alias("group"), F.round(x["contribution"], 4).alias("contribution"))).alias("factors"))


def score_table(rows: DataFrame, trees: int = K.FOREST_TREES) -> DataFrame:
    """entity_id, risk_score, anomaly_score, is_anomaly, factors (JSON), label: the store's table of scores."""
    model = fit(rows, trees=trees)
    risk = predict(model, rows).select("entity_id", "risk_score", "label")
    odd = isolation_scores(rows)
    why = explain(model, rows).select("entity_id", F.to_json("factors").alias("factors"))
    return risk.join(odd, "entity_id").join(why, "entity_id").select("entity_id", "risk_score", "anomaly_score", "is_anomaly", "factors", F.col("label").cast("int").alias("label"))
