"""Peeling chains: paths of one-input, two-output transactions that carry most of a balance onward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..shared import materialize


def first_spender(tx: DataFrame) -> DataFrame:
    """(address, next_txid): the first transaction, by time and txid, that spends an address."""
    uses = tx.where("ts_micro is not null").select("txid", "ts_micro", F.explode("input_addresses").alias("address"))
    return uses.where("address is not null").groupBy("address").agg(F.min_by("txid", F.struct("ts_micro", "txid")).alias("next_txid"))


def successors(tx: DataFrame) -> DataFrame:
    """(txid, carried_address, next_txid): the output that carries a peel-shaped transaction's balance onward.

    Of the outputs whose first spender is peel-shaped the one greatest in (amount, address, next_txid), if it holds
    at least MIN_CARRY_SHARE of all outputs.
    """
    peel = tx.where("n_inputs = 1 and n_outputs = 2")
    outputs = peel.select("txid", F.explode(F.arrays_zip("output_addresses", "output_amounts")).alias("o"), F.expr("aggregate(output_amounts, 0L, (a, x) -> a + coalesce(x, 0L))").alias("total"))
    outputs = outputs.select("txid", "total", F.col("o.output_addresses").alias("address"), F.col("o.output_amounts").alias("amount"))
    spent = outputs.join(first_spender(tx), "address").join(peel.select(F.col("txid").alias("next_txid")), "next_txid", "left_semi")
    best = spent.groupBy("txid", "total").agg(F.max(F.struct("amount", "address", "next_txid")).alias("b"))
    return best.where("total > 0").where(F.col("b.amount") / F.col("total") >= K.MIN_CARRY_SHARE).select("txid", F.col("b.address").alias("carried_address"), F.col("b.next_txid").alias("next_txid"))


def walks(next_of: DataFrame) -> DataFrame:
    """(start, hop, txid): the walk from each start along (txid, next_txid), by pointer doubling.

    A start is a txid with a successor that is nobody's successor.  A walk ends before it would come back to a
    transaction of its own; walks may run into the same tail.  The number of rounds is the logarithm of the
    longest walk.
    """
    links = materialize(next_of.select("txid", "next_txid"), "links")
    starts = links.select("txid").join(links.select(F.col("next_txid").alias("txid")), "txid", "left_anti").distinct()
    rows = materialize(starts.select(F.col("txid").alias("start"), F.lit(0).cast("bigint").alias("hop"), "txid"), "walk")
    jump, reach, n = links, 1, rows.count()
    while n:
        further = rows.join(jump, "txid").select("start", (F.col("hop") + reach).alias("hop"), F.col("next_txid").alias("txid"))
        # in a walk that meets itself the least hop of a transaction is where it was met first
        grown = materialize(rows.select("start", "hop", "txid").unionByName(further).groupBy("start", "txid").agg(F.min("hop").alias("hop")), "walk")
        m = grown.count()
        rows = grown.select("start", "hop", "txid")
        if m == n:
            break
        n, reach = m, reach * 2
        jump = materialize(jump.join(jump.select(F.col("txid").alias("next_txid"), F.col("next_txid").alias("_far")), "next_txid").select("txid", F.col("_far").alias("next_txid")), "jump")
    return rows


#: From how many hops, up to which median peel and which spread of peels a chain is laundering-like.
LAUNDERING = (K.LAUNDERING_MIN_HOPS, K.LAUNDERING_MAX_MEDIAN_PEEL, K.LAUNDERING_MAX_SPREAD)


def detect(tx: DataFrame, min_length: int = K.MIN_CHAIN_LENGTH, laundering: tuple[int, float, float] = LAUNDERING) -> DataFrame:
    """One row per chain and hop: chain_id, start, hop, txid, carried_address, hops, peeled_sats, median_peel,
    peel_spread, laundering_like.  ``tx`` has one row per txid.

    median_peel is the upper median of the peel shares; carried_address is null at the last hop; the short
    chain_id (``CH-`` and 10 characters) is for display, start is the full key.
    """
    next_of = materialize(successors(tx), "successors")
    steps = walks(next_of)
    long_ = steps.groupBy("start").agg(F.count("*").alias("hops")).where(F.col("hops") >= min_length)
    steps = steps.join(long_, "start")
    amounts = tx.select("txid", F.expr("aggregate(output_amounts, 0L, (a, x) -> a + coalesce(x, 0L))").alias("total"), F.array_min("output_amounts").alias("peel"))
    priced = steps.join(amounts, "txid").join(next_of.select("txid", "carried_address"), "txid", "left")
    share = F.when(F.col("total") > 0, F.col("peel") / F.col("total"))
    by = priced.groupBy("start").agg(F.sum("peel").alias("peeled_sats"), F.array_sort(F.collect_list(share)).alias("shares"))
    n = F.size("shares")
    median = F.when(n == 0, 0.0).otherwise(F.get("shares", F.floor(n / 2).cast("int")))
    spread = F.when(n < 2, 1.0).otherwise(F.array_max("shares") - F.array_min("shares"))
    by = by.select("start", "peeled_sats", median.alias("median_peel"), spread.alias("peel_spread"))
    out = priced.join(by, "start")
    like = (F.col("hops") >= laundering[0]) & (F.col("median_peel") <= laundering[1]) & (F.col("peel_spread") <= laundering[2])
    carried = F.when(F.col("hop") < F.col("hops") - 1, F.col("carried_address"))
    return out.select(F.concat(F.lit("CH-"), F.substring("start", 1, 10)).alias("chain_id"), "start", "hop", "txid", carried.alias("carried_address"), "hops", "peeled_sats", "median_peel", "peel_spread", like.alias("laundering_like"))


def with_entities(chains: DataFrame, owners: DataFrame) -> DataFrame:
    """Chains with the entity of the first carried address, null if it has none (``owners``: address, entity_id)."""
    first = chains.where("hop = 0").select("start", F.col("carried_address").alias("address")).join(owners, "address", "left").select("start", "entity_id")
    return chains.join(first, "start", "left")


def consecutive(chains: DataFrame) -> DataFrame:
    """(start, txid, next_txid): neighbouring transactions of a chain."""
    w = Window.partitionBy("start").orderBy("hop")
    return chains.select("start", "txid", F.lead("txid").over(w).alias("next_txid")).where("next_txid is not null")
