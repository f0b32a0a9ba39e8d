"""Scoring results against labels: pairwise co-membership, classification metrics, majority labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets per unit of a score in running sums; scores lie between 0 and 1.
BUCKETS = 4096


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def pairwise_scores(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: precision, recall and f1 of pairs that share ``predicted`` against pairs that share ``actual``.

    Pairs are counted from group sizes, never listed.  Without pairs a ratio is 0.
    """
    cells = rows.groupBy(predicted, actual).agg(F.count("*").alias("n"))
    total = lambda df, c: df.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias(c))
    both = total(cells, "v").select(F.lit("both").alias("k"), "v")
    by_p = total(cells.groupBy(predicted).agg(F.sum("n").alias("n")), "v").select(F.lit("predicted").alias("k"), "v")
    by_a = total(cells.groupBy(actual).agg(F.sum("n").alias("n")), "v").select(F.lit("actual").alias("k"), "v")
    one = both.unionByName(by_p).unionByName(by_a).agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("both", "predicted", "actual")))
    p = F.coalesce(F.col("both") / F.nullif("predicted", F.lit(0.0)), F.lit(0.0))
    r = F.coalesce(F.col("both") / F.nullif("actual", F.lit(0.0)), F.lit(0.0))
    return one.select(p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def classification(rows: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: n, prevalence, precision, recall, f1 at the threshold, and the average precision over all thresholds.

    Rows without score or label are left out.  Equal scores enter the average precision together: rows are combined
    per score first, so the running sum goes over distinct scores.
    """
    kept = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).alias("s"), F.col(label).cast("bigint").alias("y"))
    by = kept.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    # running sums in two levels: over buckets of the score, then within each bucket
    by = by.withColumn("bucket", F.floor(F.col("s") * BUCKETS))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = by.groupBy("bucket").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bp"))
    offsets = buckets.select("bucket", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("p0"))
    w = Window.partitionBy("bucket").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    steps = by.join(offsets, "bucket").select("s", "n", "pos", ((F.sum("pos").over(w) + F.col("p0")) / (F.sum("n").over(w) + F.col("n0"))).alias("at"))
    sums = steps.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.when(F.col("s") >= threshold, F.col("n")).otherwise(0)).alias("flagged"), F.sum(F.when(F.col("s") >= threshold, F.col("pos")).otherwise(0)).alias("hit"), F.sum(F.col("at") * F.col("pos")).alias("area"))
    p = F.coalesce(F.col("hit") / F.nullif("flagged", F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("hit") / F.nullif("pos", F.lit(0)), F.lit(0.0))
    return sums.select("n", (F.col("pos") / F.col("n")).alias("prevalence"), p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), F.coalesce(F.col("area") / F.nullif("pos", F.lit(0)), F.lit(0.0)).alias("average_precision"))


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent non-null value of each group, the least of equally frequent ones."""
    counts = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    best = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(group, value, "n")
