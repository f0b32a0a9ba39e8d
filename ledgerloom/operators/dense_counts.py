"""Per-key counts by dense accumulator arrays, even when a few keys hold most rows.

Where items are counted, rows are first combined per (key, item) - a shuffle on both, so a hot key is spread over its
items -; where only rows are, they stay as they are.  Keys are
dictionary-encoded as integers 0..n-1, each input split adds its rows into dense arrays with ``numpy.bincount``
and ``ufunc.at``, and the array blocks of all splits are summed in a two-level tree reduction.
No task's work depends on how rows are spread over keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, slots
from ..skew import dense_dictionary, lookup

#: Keys per array block.
BLOCK = 4096
#: Live blocks a task holds before it hands them on (about 128 kB each).
LIVE = 512
#: Splits are reduced in this many lanes before the lanes of a block are reduced to one.
LANES = 16

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_ARRAYS = "block bigint, lane int, at binary, n binary, items binary, first binary, last binary"
_NAMES = ["block", "lane", "at", "n", "items", "first", "last"]


class _Blocks:
    """Dense accumulators by block number: rows, items, least and greatest time."""

    def __init__(self) -> None:
        self.live: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, block: int, at: np.ndarray, n: np.ndarray, items: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        if block not in self.live:
            self.live[block] = (np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64), np.full(BLOCK, _HIGH), np.full(BLOCK, _LOW))
        a, b, lo, hi = self.live[block]
        # bincount's weights are doubles, exact to 2**53; a batch stays far below
        a += np.bincount(at, weights=n, minlength=BLOCK).astype(np.int64) if n.sum() < 1 << 53 else _exact(at, n)
        b += np.bincount(at, weights=items, minlength=BLOCK).astype(np.int64) if items.sum() < 1 << 53 else _exact(at, items)
        np.minimum.at(lo, at, first)
        np.maximum.at(hi, at, last)

    def flush(self, lane: int) -> Iterator[pa.RecordBatch]:
        rows = []
        for block, (n, items, first, last) in self.live.items():
            at = np.flatnonzero(n)  # sparsely filled blocks travel as places and values
            rows.append((block, lane, at.astype(np.int16).tobytes(), *(x[at].tobytes() for x in (n, items, first, last))))
        self.live.clear()
        if rows:
            kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def _exact(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(BLOCK, np.int64)
    np.add.at(out, at, values)
    return out


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    lane, acc = TaskContext.get().partitionId() % LANES, _Blocks()
    for b in batches:
        ident = b["id"].to_numpy(zero_copy_only=False)
        cols = [b[c].fill_null(f).to_numpy(zero_copy_only=False) for c, f in (("n", 0), ("items", 0), ("first", _HIGH), ("last", _LOW))]
        order = np.argsort(ident, kind="stable")
        blocks = ident[order] // BLOCK
        cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True]) if len(blocks) else []
        for s, e in zip(cuts[:-1], cuts[1:]):
            pick = order[s:e]
            acc.add(int(blocks[s]), ident[pick] % BLOCK, *(c[pick] for c in cols))
            if len(acc.live) >= LIVE:
                yield from acc.flush(lane)
    yield from acc.flush(lane)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum array blocks that come sorted by (block, lane)."""
    acc, now = _Blocks(), None
    for b in batches:
        for r in b.to_pylist():
            if now not in (None, (r["block"], r["lane"])):
                yield from acc.flush(now[1])
            now = (r["block"], r["lane"])
            acc.add(r["block"], np.frombuffer(r["at"], np.int16).astype(np.int64), *(np.frombuffer(r[c], np.int64) for c in _NAMES[3:]))
    if now:
        yield from acc.flush(now[1])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ident = np.frombuffer(r["at"], np.int16).astype(np.int64) + r["block"] * BLOCK
            n, items, first, last = (np.frombuffer(r[c], np.int64) for c in _NAMES[3:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ident), pa.array(n), pa.array(items), pa.array(first, mask=first == _HIGH), pa.array(last, mask=last == _LOW)], names=["id", "n", "items", "first", "last"]
            )


def per_key_counts(rows: DataFrame, key: Column, item: Column | None, time: Column | None = None) -> DataFrame:
    """One row per key: key, n (rows), items (distinct non-null items), first and last (least and greatest time).

    Null keys are left out (use ``rows.count()`` for a total that holds them); null items count as rows only;
    null times are left out of first and last, which are null for a key without any time.  Repeated rows count
    each.  An empty input gives no rows; other columns of ``rows`` are never read.  Without an item (None) nothing is
    combined first: the rows themselves are encoded and counted.
    """
    t = F.lit(None).cast("bigint") if time is None else time.cast("bigint")
    keyed = rows.select(key.alias("key"), *([] if item is None else [item.alias("item")]), t.alias("t")).where(F.col("key").isNotNull())
    if item is None:
        pairs = keyed.select("key", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("items"), F.col("t").alias("first"), F.col("t").alias("last"))
    else:
        pairs = keyed.groupBy("key", "item").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).select("key", "n", F.col("item").isNotNull().cast("bigint").alias("items"), "first", "last")
    pairs = materialize(pairs, "pairs")
    dictionary, n_keys = dense_dictionary(pairs.select("key").distinct(), "key")
    dictionary = materialize(dictionary, "keys")
    encoded = lookup(pairs, "key", dictionary, n_keys, "id", written=True).select("id", "n", "items", "first", "last")
    arrays = encoded.mapInArrow(_accumulate, _ARRAYS)
    parts = max(1, min(slots(rows.sparkSession), n_keys // BLOCK + 1))
    by_lane = arrays.repartition(min(parts * LANES, slots(rows.sparkSession)), "block", "lane").sortWithinPartitions("block", "lane").mapInArrow(_reduce, _ARRAYS)
    summed = by_lane.withColumn("lane", F.lit(0)).repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_reduce, _ARRAYS)
    counts = summed.mapInArrow(_decode, "id bigint, n bigint, items bigint, first bigint, last bigint")
    return counts.join(dictionary, "id").select("key", "n", "items", "first", "last")


def heavy_keys(rows: DataFrame, key: Column, one_in: int) -> DataFrame:
    """Keys that hold at least one in ``one_in`` of all rows, rows without a key counted in the total: key, n."""
    total = rows.count()
    return per_key_counts(rows, key, None).where(F.col("n") * one_in >= total).select("key", "n")
