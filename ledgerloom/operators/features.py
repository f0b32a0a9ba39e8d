"""The feature matrix: 28 numbers per entity from ledger, chains, flags and leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..shared import materialize


def extract(tx: DataFrame, owners: DataFrame, flags: DataFrame, chains: DataFrame, leads: DataFrame, min_transactions: int = K.SCORING_MIN_TRANSACTIONS) -> DataFrame:
    """entity_id and the features of ``constants.FEATURES`` as doubles, nulls as 0.

    ``tx`` has one row per txid, ``owners`` one per address, ``flags`` txid and is_coinjoin, ``chains`` one row per
    chain with start, entity_id, hops, median_peel and laundering_like.  An entity is in the table if it spends in at
    least ``min_transactions`` transactions.  All sides are aggregated by entity_id before they are joined.
    """
    first = tx.select("txid", "ts_micro", "total_out", "fee", "n_inputs", "n_outputs", "script_type", "output_addresses", F.get("input_addresses", F.lit(0)).alias("address"))
    spend = materialize(first.join(owners.select("address", "entity_id"), "address").drop("address"), "spend")
    at = F.timestamp_micros("ts_micro")
    day, hour = F.date_trunc("day", at), F.hour(at)
    base = spend.groupBy("entity_id").agg(
        F.count("*").alias("n_transactions"),
        F.sum("total_out").alias("total_out"),
        F.avg("total_out").alias("mean_value"),
        F.stddev_pop("total_out").alias("value_spread"),
        F.avg("fee").alias("mean_fee"),
        F.stddev_pop("fee").alias("fee_spread"),
        F.avg("n_inputs").alias("mean_inputs"),
        F.avg("n_outputs").alias("mean_outputs"),
        F.max("n_inputs").alias("max_inputs"),
        F.avg(hour).alias("mean_hour"),
        (F.sum(F.when(hour < 6, 1).otherwise(0)).cast("double") / F.count("*")).alias("nocturnal_share"),
        # the hours there are, as the bits of a number
        (F.bit_count(F.bit_or(F.expr("shiftleft(1, hour(timestamp_micros(ts_micro)))"))) / 24.0).alias("hour_coverage"),
    )
    # values of an entity are made distinct where they lie, not by repeating every row for each kind of them
    distinct = lambda c, name: spend.select("entity_id", c.alias("x")).where("x is not null").distinct().groupBy("entity_id").agg(F.count("*").alias(name))
    base = base.where(F.col("n_transactions") >= min_transactions)
    for side in (distinct(day, "active_days"), distinct(F.col("script_type"), "n_script_types"), medians(spend, "entity_id", "total_out").withColumnRenamed("median", "median_value")):
        base = base.join(side, "entity_id", "left")
    base = base.withColumn("tx_per_active_day", F.col("n_transactions") / F.nullif("active_days", F.lit(0)))
    # outputs are counted per payer and address before they meet their owners
    paid = spend.select("entity_id", F.explode("output_addresses").alias("address")).groupBy("entity_id", "address").agg(F.count("*").alias("n"))
    flow = paid.join(owners.select("address", F.col("entity_id").alias("payee")), "address").where("payee <> entity_id").groupBy("entity_id", "payee").agg(F.sum("n").alias("n"))
    flow = materialize(flow, "flow")
    fan_out = flow.groupBy("entity_id").agg(F.count("*").alias("fan_out"))
    fan_in = flow.groupBy(F.col("payee").alias("entity_id")).agg(F.sum("n").alias("n_received"), F.count("*").alias("fan_in"))
    sizes = owners.groupBy("entity_id").agg(F.count("*").alias("n_addresses"))
    flag = lambda c: F.max(F.when(F.col(c), 1).otherwise(0))
    chained = chains.where("entity_id is not null").groupBy("entity_id").agg(F.max("hops").alias("chain_hops"), F.min("median_peel").alias("chain_median_peel"), flag("laundering_like").alias("chain_laundering_like"))
    mixed = spend.join(flags.select("txid", "is_coinjoin"), "txid").groupBy("entity_id").agg((F.sum(F.when(F.col("is_coinjoin"), 1).otherwise(0)).cast("double") / F.count("*")).alias("coinjoin_share"))
    led = leads.where("entity_id is not null").groupBy("entity_id").agg(flag("significant").alias("has_attribution"), F.max(F.col("hits") / F.nullif("transactions", F.lit(0))).alias("first_relay_share"), F.max("n_countries").alias("n_countries"), F.max("n_asns").alias("n_asns"), F.max("top_asn_share").alias("top_asn_share"))
    out = base
    for side in (sizes, fan_out, fan_in, chained, mixed, led):
        out = out.join(side, "entity_id", "left")
    default = {"n_addresses": 1.0}
    return out.select("entity_id", *(F.coalesce(F.col(f).cast("double"), F.lit(default.get(f, 0.0))).alias(f) for f in K.FEATURES))


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median) of the non-null values, the mean of the middle two where their number is even.

    Equal values are counted first, and the middle is found by a running sum over the counts in order of value, so no
    group's values are held at once.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    totals = counts.groupBy(group).agg(F.sum("c").alias("n"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.expr("(n + 1) div 2"), F.expr("(n + 2) div 2")
    holds = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("c") < k)
    middle = upto.join(totals, group).select(group, F.when(holds(low), F.col("v")).alias("a"), F.when(holds(high), F.col("v")).alias("b")).where("a is not null or b is not null")
    return middle.groupBy(group).agg(((F.max("a").cast("double") + F.max("b").cast("double")) / 2).alias("median"))


def group_of(feature: str) -> str:
    """The group a feature belongs to."""
    return next(g for g, names in K.FEATURE_GROUPS.items() if feature in names)
