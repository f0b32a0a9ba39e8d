"""Connected components of pairwise matches on a two-dimensional grid of edge blocks.

Vertices are hashed into p blocks, an edge goes to the cell (block of one end, block of the other), and each cell
runs a local union-find over its edges.  A vertex then takes the least representative that its row and column
cells found, the representatives themselves are the vertices of the next, smaller round, and rounds go on until no
edge is left; where a round did little, parents jump to their parents, so a path of n takes about log n rounds.  A hub's edges are spread over a whole row of cells.  Labels are resolved backwards through the
written parent tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import clean_address, clean_id
from ..shared import materialize, slots
from ..skew import dense_dictionary, lookup

#: Edges a cell works on at a time; a fuller cell is worked through in pieces, which only costs further rounds.
PIECE = 2_000_000
#: Edges per cell the grid is sized for.
CELL = 1_000_000


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges (u, v) and for each the least vertex of its component."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return names, names[root]
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def piece() -> Iterator[pa.RecordBatch]:
        v, root = union_find(np.concatenate(us), np.concatenate(vs))
        lower = v != root
        for s in range(0, len(v), 100_000):
            pick = lower[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(v[s : s + 100_000][pick]), pa.array(root[s : s + 100_000][pick])], names=["v", "root"])

    us, vs, held = [], [], 0
    for b in batches:
        us.append(b["u"].to_numpy())
        vs.append(b["v"].to_numpy())
        held += len(us[-1])
        if held >= PIECE:
            yield from piece()
            us, vs, held = [], [], 0
    if held:
        yield from piece()


def component_labels(edges: DataFrame) -> DataFrame:
    """``edges`` has integer columns u and v; returns (v, label) with the least vertex of each component as label.

    Vertices that are their own label (and those without edges) have no row.  Self loops, repeated edges and edges
    in either direction are allowed; edges with a null end are ignored.  No edges give no rows.
    """
    spark = edges.sparkSession
    n_slots = slots(spark)
    now = edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("bigint"), F.col("v").cast("bigint"))
    parents: list[tuple[DataFrame, int]] = []
    left, before = now.count(), 0
    while left:
        p = max(int(np.ceil(np.sqrt(left / CELL))), int(np.sqrt(min(n_slots, left // 20_000 + 1))))
        cell = F.pmod(F.xxhash64("u"), F.lit(p)) * p + F.pmod(F.xxhash64("v"), F.lit(p))
        found = now.repartitionById(p * p, cell.cast("int")).mapInArrow(_cell, "v bigint, root bigint")
        met = materialize(found.groupBy("v").agg(F.min("root").alias("parent"), F.collect_set("root").alias("roots")), "met")
        roots = met.select(F.explode("roots").alias("v")).distinct()
        n_parents = met.count()
        if left * 2 > before > 0:
            # the last round did little (long paths): jump to the parent's parent, which halves the way to go
            grand = met.select(F.col("v").alias("parent"), F.col("parent").alias("grand"))
            met = materialize(lookup(met, "parent", grand, n_parents, "grand", written=True).withColumn("parent", F.coalesce("grand", "parent")).drop("grand"), "jumped")
        parents.append((met.select("v", "parent"), n_parents))
        others = met.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("parent").alias("v")).where("u <> v")
        alive = met.join(roots, "v", "left_semi").select(F.col("v").alias("u"), F.col("parent").alias("v"))
        now = materialize(others.union(alive).distinct(), "edges")
        left, before = now.count(), left
    if not parents:
        return spark.createDataFrame([], "v bigint, label bigint")
    # a vertex that lives on into the next round is labelled there; one that does not has its parent alive there
    labels, n = None, 0
    for table, size in reversed(parents):
        if labels is None:
            labels, n = table.withColumnRenamed("parent", "label"), size
            continue
        mine = table.join(labels.select("v"), "v", "left_anti")
        up = lookup(mine.withColumnRenamed("v", "_v").withColumnRenamed("parent", "v"), "v", labels, n, "label")
        labels = materialize(up.select(F.col("_v").alias("v"), F.coalesce("label", "v").alias("label")).unionByName(labels), "labels")
        n += size
    return labels


def address_groups(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """(address, group_address): each address of the two tables with the least address of its group.

    A row of ``clusters`` ties its address to its cluster_id, a row of ``entities`` its address to its entity_id.
    Null and blank keys tie nothing; an address that is tied to nothing is its own group; a row without an address
    gives none.  Repeated rows and an address under several clusters are allowed; other columns are not read.
    """
    # addresses come first in the order of names, so the least vertex of a group is its least address
    ties = (
        clusters.select(clean_address("address").alias("address"), F.concat(F.lit("1"), clean_id("cluster_id")).alias("other"))
        .unionByName(entities.select(clean_address("address").alias("address"), F.concat(F.lit("2"), clean_id("entity_id")).alias("other")))
        .where("address is not null")
        .select(F.concat(F.lit("0"), "address").alias("address"), "other")
    )
    # repeated ties are left in: the names are made distinct, and union-find takes an edge as often as it comes
    names = ties.select(F.col("address").alias("name")).union(ties.select("other").where("other is not null")).distinct()
    dictionary, n = dense_dictionary(names, "name", ordered=True)
    dictionary = materialize(dictionary, "names")
    bound = ties.where("other is not null")
    by_address = bound.join(dictionary.select(F.col("name").alias("address"), F.col("id").alias("u")), "address").select("u", F.col("other").alias("name"))
    edges = materialize(lookup(by_address, "name", dictionary, n, "id").select("u", F.col("id").alias("v")), "edges")
    labels = component_labels(edges)
    addresses = dictionary.where(F.col("name").startswith("0"))
    labelled = addresses.join(labels.withColumnRenamed("v", "id"), "id", "left").select("name", F.coalesce("label", "id").alias("id"))
    groups = lookup(labelled.withColumnRenamed("name", "address"), "id", addresses.select("id", F.col("name").alias("group_address")), n, "group_address")
    return groups.select(F.expr("substring(address, 2)").alias("address"), F.expr("substring(group_address, 2)").alias("group_address"))
