"""Mixing transactions by structure: several inputs, and outputs that repeat one amount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def classify(tx: DataFrame, min_inputs: int = K.MIN_INPUTS, min_outputs: int = K.MIN_OUTPUTS, min_equal: int = K.MIN_EQUAL_OUTPUTS) -> DataFrame:
    """(txid, is_coinjoin, equal_count, denomination, coinjoin_reason) for rows with input_addresses and output_amounts.

    The denomination is the most frequent output amount, the first of equally frequent ones.  A null array counts as empty.
    Everything is a column expression on the row, so nothing is shuffled.
    """
    n_in = F.coalesce(F.size("input_addresses"), F.lit(0))
    n_out = F.coalesce(F.size("output_amounts"), F.lit(0))
    # runs of equal values in the sorted array, longest first, then the value that comes first in the original
    values = F.array_distinct("output_amounts")
    groups = F.transform(values, lambda v, i: F.struct(F.size(F.filter("output_amounts", lambda x: x.eqNullSafe(v))).alias("n"), (-i).alias("at"), v.alias("value")))
    tx = tx.select("txid", n_in.alias("n_in"), n_out.alias("n_out"), F.array_max(groups).alias("top"))
    small = (F.col("n_in") < min_inputs) | (F.col("n_out") < min_outputs)
    few = F.col("top.n") < min_equal
    too_small, too_few, mixes = K.MIXING_REASONS
    reason = (
        F.when(small, F.format_string(too_small, "n_in", "n_out"))
        .when(few, F.format_string(too_few, "top.n", F.lit(min_equal)))
        .otherwise(F.format_string(mixes, "top.n", F.col("top.value") / 1e8, "n_in"))
    )
    return tx.select(
        "txid",
        (~small & ~few).alias("is_coinjoin"),
        F.when(small, 0).otherwise(F.col("top.n")).cast("bigint").alias("equal_count"),
        F.when(~small & ~few, F.col("top.value")).alias("denomination"),
        reason.alias("coinjoin_reason"),
    )
