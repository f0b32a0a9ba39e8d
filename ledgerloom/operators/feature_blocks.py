"""One wide feature row per entity from its events, built in blocks of event types.

The types, hundreds of them, are numbered and cut into blocks before anything is aggregated, and every event carries its
type's block.  Events are aggregated by (block, type, address), so a busy address is combined where it lies, then by
(block, type, entity), and written once, a directory per block.  Each block is read by itself, made one array of structs per
entity and joined, hash-partitioned like the others, onto the complete entity table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keys import clean_address, clean_id
from ..shared import materialize, slots
from ..skew import dense_dictionary, lookup

#: Event types per block, and blocks there are at most: with more types than both allow, blocks are wider.
TYPES_PER_BLOCK, MAX_BLOCKS = 128, 16

FEATURE = "event_type, n, last_ts, last_txid, total_out, fee"


def transactions(tx: DataFrame) -> DataFrame:
    """One row per txid of the ledger table (repeated rows are equal in all columns); rows without a txid are none."""
    cols = ["txid", "ts_micro", F.get("input_addresses", F.lit(0)).alias("first_input"), "script_type", "n_inputs", "n_outputs", "total_out", "fee"]
    return tx.select(*cols).where("txid is not null").dropDuplicates(["txid"])


def address_entities(entities: DataFrame) -> DataFrame:
    """(address, entity_id), retired or not; an address has one entity (the least id, should there be more)."""
    clean = entities.select(clean_address("address").alias("address"), clean_id("entity_id").alias("entity_id"))
    return clean.where("address is not null and entity_id is not null").groupBy("address").agg(F.min("entity_id").alias("entity_id"))


def _event_type() -> Column:
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(":", "script_type", number("n_inputs"), number("n_outputs"))


def type_blocks(tx: DataFrame) -> tuple[DataFrame, int]:
    """(event_type, block) of all types of the ledger, numbered in their order, and the number of blocks (1 at least)."""
    types = tx.where("script_type is not null").select(_event_type().alias("event_type")).distinct()
    numbered, n = dense_dictionary(types, "event_type", ordered=True)
    width = max(TYPES_PER_BLOCK, -(-n // MAX_BLOCKS))
    return materialize(numbered.select("event_type", (F.col("id") / width).cast("int").alias("block")), "types"), max(1, -(-n // width))


def block_counts(tx: DataFrame, entities: DataFrame) -> tuple[DataFrame, int]:
    """Per (block, event_type, entity_id): n, last_ts, last_txid, total_out and fee (sums without nulls, null if all are); the
    table is written by block.  Also the number of blocks."""
    blocks, n_blocks = type_blocks(tx)
    first: Column = clean_address("first_input")
    events = transactions(tx).where("ts_micro is not null and script_type is not null").withColumn("address", first)
    events = events.where("address is not null").select("txid", "ts_micro", "address", _event_type().alias("event_type"), "total_out", "fee")
    events = lookup(events, "event_type", blocks, blocks.count(), "block")
    combined = events.groupBy("block", "event_type", "address").agg(*_combine(F.lit(1), F.struct("ts_micro", "txid"), F.col("total_out"), F.col("fee")))
    named = combined.join(address_entities(entities), "address")
    again = named.groupBy("block", "event_type", "entity_id").agg(*_combine(F.col("n"), F.col("last"), F.col("total_out"), F.col("fee")))
    counts = again.select("entity_id", "event_type", "n", F.col("last.ts_micro").alias("last_ts"), F.col("last.txid").alias("last_txid"), "total_out", "fee", "block")
    return materialize(counts, "block-counts", by="block"), n_blocks


def _combine(n: Column, last: Column, total_out: Column, fee: Column) -> list[Column]:
    return [F.sum(n).alias("n"), F.max(last).alias("last"), F.sum(total_out).alias("total_out"), F.sum(fee).alias("fee")]


def entity_features(tx: DataFrame, entities: DataFrame) -> tuple[DataFrame, int]:
    """The complete entity table with one column per block of event types, and the number of blocks.

    Columns entity_id, block_0, block_1, ...; a block is an array of structs (event_type, n, last_ts, last_txid,
    total_out, fee), null for an entity without an event of the block.  Every entity_id of ``entities`` has one row,
    also one without events; null and blank ids have none.  Empty inputs give an empty table or null blocks.
    """
    parts = slots(tx.sparkSession)
    counts, n_blocks = block_counts(tx, entities)
    wide = entities.select(clean_id("entity_id").alias("entity_id")).where("entity_id is not null").distinct().repartition(parts, "entity_id")
    for b in range(n_blocks):
        # only the block's own directory is read
        block = counts.where(F.col("block") == b).repartition(parts, "entity_id").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(*FEATURE.split(", ")))).alias(f"block_{b}"))
        wide = wide.join(block, "entity_id", "left")
    return wide, n_blocks


def long_features(wide: DataFrame, n_blocks: int) -> DataFrame:
    """The feature table as one row per entity and type it has events of."""
    every = F.concat(*(F.coalesce(f"block_{b}", F.array()) for b in range(n_blocks)))
    return wide.select("entity_id", F.inline(every))
