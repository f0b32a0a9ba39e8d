"""Clusters of addresses: inputs spent together, then change outputs merged within a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..shared import materialize
from ..skew import dense_dictionary, lookup
from .components import component_labels


def group_names(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(name, group): each of ``vertices`` (column name) with the least name (byte order) of its component.

    ``edges`` has the string columns a and b, whose ends are all vertices; null ends tie nothing.
    """
    dictionary, n = dense_dictionary(vertices.where("name is not null").select("name").distinct(), "name", ordered=True)
    dictionary = materialize(dictionary, "names")
    pairs = edges.where("a is not null and b is not null and a <> b").distinct()
    left = lookup(pairs.withColumnRenamed("a", "name"), "name", dictionary, n, "id").select(F.col("id").alias("u"), F.col("b").alias("name"))
    coded = lookup(left, "name", dictionary, n, "id").select("u", F.col("id").alias("v"))
    labels = component_labels(materialize(coded, "edges"))
    labelled = dictionary.join(labels.withColumnRenamed("v", "id"), "id", "left").select("name", F.coalesce("label", "id").alias("id"))
    return lookup(labelled, "id", dictionary.withColumnRenamed("name", "group"), n, "group").select("name", "group")


def cospend_groups(tx: DataFrame, flags: DataFrame) -> DataFrame:
    """(address, group): input addresses of one transaction that mixes nothing share a group; every address is in one.

    Addresses of mixing transactions take part without being tied by them.
    """
    plain = tx.join(flags.where("not is_coinjoin").select("txid"), "txid", "left_semi")
    edges = plain.select(F.get("input_addresses", F.lit(0)).alias("a"), F.explode("input_addresses").alias("b"))
    vertices = tx.select(F.explode(F.array_union(F.coalesce("input_addresses", F.array()), F.coalesce("output_addresses", F.array()))).alias("name"))
    return group_names(edges, vertices).select(F.col("name").alias("address"), "group")


def _replay(frame: pd.DataFrame) -> pd.DataFrame:
    """Change merges of groups that may meet, in order of time, each priced by the sizes its groups have by then."""
    parent, size = {}, {}
    for a, b, n_a, n_b in zip(frame["a"], frame["b"], frame["n_a"], frame["n_b"]):
        parent.setdefault(a, a), parent.setdefault(b, b)
        size.setdefault(a, n_a), size.setdefault(b, n_b)

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, confidence in frame.sort_values(["ts_micro", "txid"])[["a", "b", "change_confidence"]].itertuples(index=False):
        low, high = sorted((root(a), root(b)))
        if low != high and (size[low] * size[high] <= K.MERGE_BUDGET or confidence >= K.MERGE_ANYWAY_CONFIDENCE):
            parent[high] = low
            size[low] += size[high]
    return pd.DataFrame({"group": list(parent), "merged": [root(x) for x in parent]})


def budgeted_merge(tx: DataFrame, flags: DataFrame, groups: DataFrame) -> DataFrame:
    """(address, group) after the change merges of ``flags`` on the co-spend ``groups``.

    A merge joins the first input's group and the change address's if the call is corroborated and confident
    enough, and either the product of the two sizes is within the budget or the confidence is high.  Sizes
    change with every merge, so the merges of groups that can reach each other are replayed in order of time, in
    one task per such set; different sets run in parallel.  Sizes only grow, so a call that is too large for the budget from the
    start and not confident enough is dropped before sets are formed; what a set is made of is calls that could merge.
    """
    calls = flags.where((~F.col("is_coinjoin")) & F.col("change_address").isNotNull() & F.col("change_corroborated") & (F.col("change_confidence") >= K.MIN_MERGE_CONFIDENCE))
    made = tx.select("txid", "ts_micro", F.get("input_addresses", F.lit(0)).alias("first")).where("first is not null").join(calls.select("txid", "change_address", "change_confidence"), "txid")
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    by = groups.join(sizes, "group")
    left = by.select(F.col("address").alias("first"), F.col("group").alias("a"), F.col("n").alias("n_a"))
    right = by.select(F.col("address").alias("change_address"), F.col("group").alias("b"), F.col("n").alias("n_b"))
    edges = materialize(made.join(left, "first").join(right, "change_address").where("a <> b").select("txid", "ts_micro", "a", "b", "n_a", "n_b", "change_confidence"), "merges")
    edges = edges.where((F.col("n_a") * F.col("n_b") <= K.MERGE_BUDGET) | (F.col("change_confidence") >= K.MERGE_ANYWAY_CONFIDENCE))
    ends = edges.select(F.col("a").alias("name")).union(edges.select(F.col("b").alias("name")))
    sets = group_names(edges.select("a", "b"), ends).select(F.col("name").alias("a"), F.col("group").alias("set"))
    merged = edges.join(sets, "a").groupBy("set").applyInPandas(lambda f: _replay(f), "`group` string, merged string")
    return groups.join(merged, "group", "left").select("address", F.coalesce("merged", "group").alias("group"))


def cluster_table(groups: DataFrame) -> DataFrame:
    """(address, cluster_id, cluster_size) with ids ``C-`` and 12 characters of the group's least address.

    The short id is for display and may collide; ``group`` is the full key and is kept.
    """
    sizes = groups.groupBy("group").agg(F.count("*").alias("cluster_size"))
    return groups.join(sizes, "group").select("address", F.concat(F.lit("C-"), F.substring("group", 1, 12)).alias("cluster_id"), F.col("cluster_size").cast("int").alias("cluster_size"), "group")
