"""Which of two outputs is the change: fresh address, ragged amount, script as the inputs', spent again soon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def script_of(address: Column) -> Column:
    """Script type by the prefix of an address."""
    out = F.lit(K.UNKNOWN_SCRIPT)
    for prefix, script in reversed(K.SCRIPT_PREFIXES):
        out = F.when(F.startswith(address, F.lit(prefix)), script).otherwise(out)
    return out


def score_table() -> list[float]:
    """The 16 sums of the signals' weights, by bit mask fresh, ragged, script, soon; summed once, so all agree to the bit."""
    weights = [K.WEIGHT_FRESH, K.WEIGHT_RAGGED, K.WEIGHT_SCRIPT, K.WEIGHT_SPENT_SOON]
    return [sum(w if m >> i & 1 else 0.0 for i, w in enumerate(weights)) for m in range(16)]


def first_seen(tx: DataFrame) -> DataFrame:
    """(address, seen): the first transaction, as struct (ts_micro, txid), in which an address is input or output."""
    uses = tx.select("ts_micro", "txid", F.explode(F.array_union(F.coalesce("input_addresses", F.array()), F.coalesce("output_addresses", F.array()))).alias("address"))
    return uses.where("address is not null").groupBy("address").agg(F.min(F.struct("ts_micro", "txid")).alias("seen"))


def first_spent(tx: DataFrame) -> DataFrame:
    """(address, spent_at): when an address was first an input."""
    uses = tx.select("ts_micro", F.explode("input_addresses").alias("address"))
    return uses.where("address is not null").groupBy("address").agg(F.min("ts_micro").alias("spent_at"))


def guesses(tx: DataFrame) -> DataFrame:
    """(txid, change_index, change_address, change_confidence, change_corroborated) for each transaction.

    ``tx`` has one row per txid.  Only transactions of two outputs are scored, others get a null index and
    confidence 0; so does a margin under the minimum, with the margin as its confidence.  Output 0 wins ties.
    Transactions without a time take no part in what was seen before and are not scored.
    """
    timed = tx.where("ts_micro is not null")
    two = timed.where(F.size("output_addresses") == 2)
    outputs = two.select("txid", "ts_micro", "script_type", F.posexplode(F.arrays_zip("output_addresses", "output_amounts")).alias("at", "o"))
    outputs = outputs.select("txid", "ts_micro", "script_type", "at", F.col("o.output_addresses").alias("address"), F.col("o.output_amounts").alias("amount"))
    known = outputs.join(first_seen(timed), "address", "left").join(first_spent(timed), "address", "left")
    fresh = (F.col("seen.ts_micro") == F.col("ts_micro")) & (F.col("seen.txid") == F.col("txid"))
    ragged = F.col("amount") % K.ROUND_UNIT != 0
    script = script_of(F.col("address")) == F.col("script_type")
    soon = (F.col("spent_at") - F.col("ts_micro")).between(0, K.SPENT_SOON_MICROS)
    bit = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0)
    mask = bit(fresh, 1) + bit(ragged, 2) + bit(script, 4) + bit(soon, 8)
    table = F.array(*map(F.lit, score_table()))
    scored = known.select("txid", "at", "address", F.get(table, mask).alias("score"), F.coalesce(ragged, F.lit(False)).alias("ragged"))
    pair = scored.groupBy("txid").agg(*(F.max(F.when(F.col("at") == i, F.struct("score", "address", "ragged"))).alias(f"o{i}") for i in (0, 1)))
    margin = F.abs(F.col("o0.score") - F.col("o1.score"))
    best = F.when(F.col("o0.score") >= F.col("o1.score"), 0).otherwise(1)
    made = pair.select("txid", margin.alias("margin"), best.alias("best"), "o0", "o1")
    decided = F.col("margin") >= K.MIN_MARGIN
    chosen = made.select(
        "txid",
        F.when(decided, F.col("best")).cast("bigint").alias("change_index"),
        F.when(decided, F.when(F.col("best") == 0, F.col("o0.address")).otherwise(F.col("o1.address"))).alias("change_address"),
        F.col("margin").alias("change_confidence"),
        F.when(F.col("best") == 0, F.col("o0.ragged")).otherwise(F.col("o1.ragged")).alias("change_corroborated"),
    )
    return tx.select("txid").join(chosen, "txid", "left").select("txid", "change_index", "change_address", F.coalesce("change_confidence", F.lit(0.0)).alias("change_confidence"), F.coalesce("change_corroborated", F.lit(False)).alias("change_corroborated"))


def transaction_flags(tx: DataFrame) -> DataFrame:
    """txid, is_coinjoin, coinjoin_reason, change_address, change_confidence, change_corroborated."""
    from .mixing import classify

    flags = classify(tx).select("txid", "is_coinjoin", "coinjoin_reason")
    return flags.join(guesses(tx).drop("change_index"), "txid")
