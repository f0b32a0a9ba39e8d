"""Entities: clusters joined by the addresses that carry a chain's balance onward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cospend import group_names


def fold(groups: DataFrame, chains: DataFrame) -> DataFrame:
    """(address, entity, group): each address's group after the carried addresses of a chain are joined.

    Only groups are merged (the graph is contracted to them); addresses of a chain outside ``groups`` are left out.
    """
    carried = chains.where("carried_address is not null").select("start", F.col("carried_address").alias("address"))
    met = carried.join(groups, "address").select("start", "group").distinct()
    least = met.groupBy("start").agg(F.min("group").alias("b"))
    edges = met.join(least, "start").select(F.col("group").alias("a"), "b")
    merged = group_names(edges, met.select(F.col("group").alias("name"))).select(F.col("name").alias("group"), F.col("group").alias("entity"))
    return groups.join(merged, "group", "left").select("address", F.coalesce("entity", "group").alias("entity"), "group")


def entity_table(folded: DataFrame) -> DataFrame:
    """(address, entity_id, cluster_id) with the short ids of display, ``E-`` and ``C-`` and 12 characters."""
    short = lambda prefix, c: F.concat(F.lit(prefix), F.substring(c, 1, 12))
    return folded.select("address", short("E-", "entity").alias("entity_id"), short("C-", "group").alias("cluster_id"))


def newly_merged(folded: DataFrame) -> DataFrame:
    """One row: how many groups chain evidence merged away."""
    return folded.agg((F.count_distinct("group") - F.count_distinct("entity")).alias("merged"))
