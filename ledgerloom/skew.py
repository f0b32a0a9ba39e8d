"""Dense dictionaries and lookups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, slots

#: Rows and bytes of keys and values of a lookup table that is broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000
#: A key counts as hot from this share of the rows on; so there are never more than 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def dense_dictionary(keys: DataFrame, key: str, ident: str = "id", ordered: bool = False) -> tuple[DataFrame, int]:
    """Give each row of ``keys`` (distinct values of ``key``, no nulls) an integer 0..n-1.

    Numbers are a place within the partition plus the sizes of the partitions before it: one row per
    partition reaches the driver, never the keys.  With ``ordered`` the numbers follow the byte order of keys.
    Returns the written dictionary (key, ident) and n.
    """
    spark = keys.sparkSession
    keys = keys.select(key)
    if ordered:
        keys = keys.repartitionByRange(key).sortWithinPartitions(key)
    placed = materialize(
        keys.select(key, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")),
        "dictionary",
    )
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    table = spark.createDataFrame(offsets or [(0, 0)], "_part int, _offset bigint")
    out = placed.join(F.broadcast(table), "_part").select(key, (F.col("_offset") + F.col("_place")).alias(ident))
    return out, total


def is_small(table: DataFrame, rows: int) -> bool:
    """Whether a table of ``rows`` rows may be broadcast: by its rows, then by the bytes of its texts, which are added up."""
    if rows > BROADCAST_ROWS:
        return False
    size = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    texts = [c for c, kind in table.dtypes if kind not in ("bigint", "int", "boolean", "double")]
    return not texts or (table.agg(F.sum(sum(map(size, texts), F.lit(0)))).first()[0] or 0) <= BROADCAST_BYTES


def lookup(left: DataFrame, on: str, right: DataFrame, right_rows: int, value: str, written: bool = False) -> DataFrame:
    """Left join of the unique-key table ``right`` (``on``, ``value``) without a hot task.

    A small ``right`` is broadcast.  Else rows of hot keys (at most 1 / HOT_SHARE of them, so their part of ``right`` is
    bounded) are looked up by broadcast where they lie, and only the other rows are shuffled to meet ``right``.  Null keys get
    a null value and are not shuffled either.  ``left`` is read several times then, so it is written first unless it is
    ``written`` already.
    """
    right = right.select(on, value)
    if is_small(right, right_rows):
        return left.join(F.broadcast(right), on, "left")
    left = left if written else materialize(left, "left")
    cols = [*left.columns, value]
    known = left.where(F.col(on).isNotNull())
    total = left.count()
    counts = known.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(2.0, total * HOT_SHARE))
    hot = materialize(right.join(F.broadcast(counts.select(on)), on), "hot")
    other = left.where(F.col(on).isNull()).withColumn(value, F.lit(None).cast(right.schema[value].dataType)).select(cols)
    if not hot.isEmpty():
        other = other.unionByName(known.join(F.broadcast(hot), on).select(cols))
        known = known.join(F.broadcast(hot.select(on)), on, "left_anti")
    return known.join(right, on, "left").select(cols).unionByName(other)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], limit: int = 500_000) -> DataFrame:
    """Inner join of ``rows`` with written ``groups``: one row of fixed width per key, with the number ``n`` of rows it has.

    Up to ``limit`` groups are broadcast; beyond, those that hold HOT_SHARE of the rows or more are, and only the rows of others
    are shuffled.
    """
    if groups.count() <= limit:
        return rows.join(F.broadcast(groups), on)
    hot = groups.where(F.col("n") >= max(2.0, rows.count() * HOT_SHARE))
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups, on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def dealt(rows: DataFrame, key: str, value: str, seed: int, lanes: int | None = None) -> DataFrame:
    """(key, value) with the values dealt to other keys at random, each as often as before; a function of the seed.

    Both columns are numbered in orders of their own, by hashes and in ``lanes`` tasks (else as many as the session has
    partitions), and meet on the number; only the lanes' sizes reach the driver.  Keys must be unique and are not null.
    """
    lanes = lanes or max(64, slots(rows.sparkSession))
    rows = materialize(rows.select(key, value), "dealt")

    def numbered(s: int) -> DataFrame:
        # lanes are stretches of the hash's range, so the order is that of the hash, however many lanes there are
        hashed = rows.withColumn("_hash", F.xxhash64(key, F.lit(s)))
        laned = hashed.withColumn("_lane", F.least(F.lit(lanes - 1), F.floor((F.col("_hash") / F.lit(2.0**64) + 0.5) * lanes)).cast("int"))
        offsets, total = [], 0
        for r in sorted(laned.groupBy("_lane").agg(F.count("*").alias("n")).collect()):
            offsets.append((r["_lane"], total))
            total += r["n"]
        table = rows.sparkSession.createDataFrame(offsets, "_lane int, _offset bigint")
        place = F.row_number().over(Window.partitionBy("_lane").orderBy("_hash", key))
        return laned.withColumn("_place", place).join(F.broadcast(table), "_lane").withColumn("_at", F.col("_offset") + F.col("_place"))

    return numbered(seed).select(key, "_at").join(numbered(seed + 100).select(value, "_at"), "_at").select(key, value)
