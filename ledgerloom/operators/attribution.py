"""Which host originates an entity's traffic: exact binomial tests of first sightings, corrected for their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.stats import binomial_tail
from ..shared import materialize
from ..skew import dealt


def leads(observations: DataFrame, of_tx: DataFrame, min_transactions: int = K.MIN_TRANSACTIONS, significance: float = K.SIGNIFICANCE) -> DataFrame:
    """One row per tested pair of an entity and a host.

    ``observations``: txid, src_ip, arrival_rank, asn, country; ``of_tx``: txid, entity_id.  A pair is tested if the
    entity has at least ``min_transactions`` observed transactions and the host was first for one of them.  The
    baseline is the host's share of all first sightings, whether or not their transaction has an entity.
    Sightings without a host are left out; with no first sighting there are no rows.
    """
    seen = materialize(observations.where("src_ip is not null and arrival_rank is not null").select("txid", "src_ip", "arrival_rank", "asn", "country"), "sightings")
    # a host's own rows are combined before the shuffle, so a busy host is no burden
    hosts = seen.groupBy("src_ip").agg(F.count_if(F.col("arrival_rank") == 1).alias("firsts"), F.min_by(F.struct("asn", "country"), F.struct("txid", "arrival_rank", F.coalesce("asn", F.lit(-1)), F.coalesce("country", F.lit("")))).alias("meta"))
    all_firsts = seen.where("arrival_rank = 1").count()
    met = materialize(seen.join(of_tx, "txid").select("entity_id", "txid", "src_ip", "arrival_rank"), "met")
    sizes = met.select("entity_id", "txid").distinct().groupBy("entity_id").agg(F.count("*").alias("transactions"))
    pairs = met.groupBy("entity_id", "src_ip").agg(F.sum(F.lit(1.0) / F.col("arrival_rank")).alias("rank_weight"), F.count_if(F.col("arrival_rank") == 1).alias("hits"), F.min(F.struct("txid", "arrival_rank")).alias("first_at"))
    tested = pairs.where("hits > 0").join(sizes.where(F.col("transactions") >= min_transactions), "entity_id").join(hosts.where("firsts > 0"), "src_ip")
    p = binomial_tail(F.col("hits"), F.col("transactions"), F.col("baseline"))
    priced = materialize(tested.withColumn("baseline", F.col("firsts") / F.lit(all_firsts)).withColumn("p_value", p), "tested")
    n = priced.count()
    adjusted = F.least(F.lit(1.0), F.col("p_value") * F.lit(float(n)))
    out = priced.withColumn("adjusted_p", adjusted).withColumn("confidence", 1.0 - F.col("adjusted_p"))
    significant = (F.col("transactions") >= K.MIN_TRANSACTIONS) & (F.col("adjusted_p") <= significance)
    return out.select(
        "entity_id", F.col("src_ip").alias("ip"), F.col("meta.asn").alias("asn"), F.col("meta.country").alias("country"), "hits", "transactions", "rank_weight", "baseline", "p_value", "adjusted_p", "confidence", significant.alias("significant"), "first_at", F.lit(n).cast("bigint").alias("tests")
    )


def best_per_entity(tested: DataFrame) -> DataFrame:
    """The least probable lead of each entity, the one that appeared first among equals."""
    w = Window.partitionBy("entity_id").orderBy("adjusted_p", "first_at.txid", "first_at.arrival_rank", "ip")
    return tested.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "first_at", "tests")


def geo_concentration(observations: DataFrame, of_tx: DataFrame) -> DataFrame:
    """(entity_id, n_countries, n_asns, top_country_share, top_asn_share) over an entity's first sightings.

    Null countries and networks are values of their own in the shares and are not counted as distinct ones.
    """
    first = observations.where("arrival_rank = 1").select("txid", "asn", "country").join(of_tx, "txid")
    cells = materialize(first.groupBy("entity_id", "country", "asn").agg(F.count("*").alias("n")), "cells")

    def share(c: str, distinct: str, top: str) -> DataFrame:
        by = cells.groupBy("entity_id", c).agg(F.sum("n").alias("n"))
        return by.groupBy("entity_id").agg(F.count(c).alias(distinct), (F.max("n") / F.sum("n")).alias(top))

    return share("country", "n_countries", "top_country_share").join(share("asn", "n_asns", "top_asn_share"), "entity_id")


def shuffled_owners(of_tx: DataFrame, seed: int) -> DataFrame:
    """The negative control: the same transactions and the same entities, tied at random (a function of the seed)."""
    return dealt(of_tx, "txid", "entity_id", seed)
