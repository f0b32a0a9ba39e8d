"""Filling containers of fixed capacity by minimum bin slack on the multiset of item lengths.

Only lengths matter, and there are at most ``capacity`` of them, so the plan is made from a histogram whose size does
not grow with the corpus: the longest remaining length opens a container, a bitset subset-sum over the
remaining lengths finds the multiset that fills the rest of the window closest to capacity, and the pattern is repeated
as often as the counts allow: then some length has fewer copies left than the pattern takes of it.  The plan is made in
the driver; its time follows the square of the capacity and more, not the items (0.2 s for 2,048 and 3 s for 8,192 tokens).
Items are then numbered within their length, in parallel, and the numbers are looked up in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

#: Items of one length that are numbered in one task; a length that more items have is numbered in lanes.
LANE_ITEMS = 1_000_000


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, with the largest sum of at most ``room``; longer lengths first.

    Bit s of a set says that the sum s can be reached.  A length with count c enters as groups of 1, 2, 4, ... copies,
    the sets before every group are kept, and the groups used are found backwards.
    """
    steps: list[tuple[int, int, int]] = []  # length, copies, sums before
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            use = min(copies, left)
            steps.append((length, use, reach))
            reach |= (reach << (length * use)) & mask
            left -= use
            copies *= 2
        if reach >> room & 1:
            break
    total, fill = reach.bit_length() - 1, {}
    for length, use, before in reversed(steps):
        if not before >> total & 1:
            total -= length * use
            fill[length] = fill.get(length, 0) + use
    return fill


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (copies by length) with how often each is used, covering the histogram exactly."""
    left = {k: c for k, c in histogram.items() if c > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = best_fill({k: c for k, c in left.items() if c}, capacity - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // c for k, c in fill.items())
        for k, c in fill.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
        out.append((fill, times))
    return out


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, n_tokens): a document whole, or cut at multiples of the capacity if it exceeds it."""
    piece = F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_tokens - 1) div {capacity} as int)"))).alias("piece")
    cut = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", piece)
    start = F.col("piece").cast("bigint") * capacity
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - start).alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """Assign each document of ``sizes`` (doc_id, n_tokens) to containers of ``capacity`` tokens.

    Returns doc_id, piece, start, n_tokens, container_id (from 0, without gaps).  A document with more tokens than the
    capacity is cut into full pieces and a rest, no other is cut; one without tokens or with a null size is in no
    container.  doc_id must be unique; the assignment is a function of the rows, whatever their order.
    """
    spark = sizes.sparkSession
    items = pieces(sizes.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")), capacity)
    items = materialize(items.withColumn("hash", F.xxhash64("doc_id", "piece")), "items")
    # at most capacity rows; then as many more as there are LANE_ITEMS items
    counts = [(r["n_tokens"], -(-r["n"] // LANE_ITEMS)) for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()]
    lanes_of = spark.createDataFrame(counts, "n_tokens bigint, lanes bigint")
    # lanes are stretches of the hash's range, so the order of a length's items is that of their hash
    lane = F.least(F.col("lanes") - 1, F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * F.col("lanes"))).cast("int")
    items = items.join(F.broadcast(lanes_of), "n_tokens").withColumn("lane", lane)
    lanes = sorted((r["n_tokens"], r["lane"], r["n"]) for r in items.groupBy("n_tokens", "lane").agg(F.count("*").alias("n")).collect())
    histogram: dict[int, int] = {}
    offsets = []
    for length, lane, n in lanes:
        offsets.append((length, lane, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    # a stretch of the items of one length: the first of them, copies per container, the first container
    stretches, used, containers = [], {}, 0
    for fill, times in plan(histogram, capacity):
        for length, copies in fill.items():
            stretches.append((length, used.get(length, 0), copies, containers))
            used[length] = used.get(length, 0) + copies * times
        containers += times
    numbered = items.withColumn("place", F.row_number().over(Window.partitionBy("n_tokens", "lane").orderBy("hash", "doc_id", "piece")).cast("bigint") - 1)
    offset_table = spark.createDataFrame(offsets, "n_tokens bigint, lane int, offset bigint")
    placed = numbered.join(F.broadcast(offset_table), ["n_tokens", "lane"]).withColumn("place", F.col("place") + F.col("offset"))
    # the stretches of a length as sorted arrays: at most one per pattern, and patterns are bounded by the capacity
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, copies, container in stretches:
        by_length.setdefault(length, []).append((first, copies, container))
    table = spark.createDataFrame([(k, sorted(v)) for k, v in by_length.items()], "n_tokens bigint, stretches array<struct<first:bigint,copies:bigint,container:bigint>>")
    # the last stretch that begins at or before the place
    joined = placed.join(F.broadcast(table), "n_tokens")
    found = joined.withColumn("s", F.expr("element_at(filter(stretches, x -> x.first <= place), -1)"))
    container = F.expr("s.container + (place - s.first) div s.copies")
    return found.select("doc_id", "piece", "start", "n_tokens", container.alias("container_id"))


def bound_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, the least number there can be (all tokens over the capacity, rounded up) and tokens unused."""
    total = packed.agg(F.count_distinct("container_id").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return total.select("containers", F.expr(f"(n_tokens + {capacity - 1}) div {capacity}").alias("least_containers"), (F.col("containers") * capacity - F.col("n_tokens")).alias("unused"))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row per container: container_id, n_pieces, n_tokens, unused."""
    by = packed.groupBy("container_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return by.withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
