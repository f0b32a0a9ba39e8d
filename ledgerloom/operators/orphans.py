"""References to records that do not exist, by compressed bitmaps per key range and period, then an exact check.

Keys are dictionary-encoded as integers and cut into ranges of 32768.  For each range and period (a day) one
bitmap holds the keys that are referred to and one the keys with a parent row valid throughout the period;
reference AND-NOT parent leaves the keys that may be unmet in the period, and only their references are checked
exactly, to the microsecond, by a running maximum over the parents' validity within the period.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..keys import clean_id
from ..shared import materialize, slots
from ..skew import dense_dictionary, lookup

#: Keys per range, thus bits per bitmap.
RANGE = 32768
#: Microseconds of a period.
PERIOD = 86_400_000_000
_NEVER = (1 << 63) - 1


def _micros(c: str) -> Column:
    return F.unix_micros(F.to_timestamp(F.col(c)))


def references(graph_edges: DataFrame, leads: DataFrame, scores: DataFrame) -> DataFrame:
    """All references: table_name, field_name, row_key, parent (table referred to), ref_key, at (micros)."""

    def one(df: DataFrame, table: str, field: str, row_key: str, parent: str) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), clean_id(row_key).alias("row_key"), F.lit(parent).alias("parent"), clean_id(field).alias("ref_key"), _micros("loaded_at").alias("at"))

    every = one(graph_edges, "graph_edges", "source", "id", "graph_nodes").unionByName(one(graph_edges, "graph_edges", "target", "id", "graph_nodes"))
    every = every.unionByName(one(leads, "leads", "entity_id", "entity_id", "entities")).unionByName(one(scores, "scores", "entity_id", "entity_id", "entities"))
    return every.where("ref_key is not null")


def parents(graph_nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Validity of the records referred to: parent, ref_key, since, until (micros; never loaded or retired: the end of time)."""

    def one(df: DataFrame, table: str, key: str) -> DataFrame:
        return df.select(F.lit(table).alias("parent"), clean_id(key).alias("ref_key"), F.coalesce(_micros("loaded_at"), F.lit(_NEVER)).alias("since"), F.coalesce(_micros("retired_at"), F.lit(_NEVER)).alias("until"))

    return one(graph_nodes, "graph_nodes", "id").unionByName(one(entities, "entities", "entity_id")).where("ref_key is not null").distinct()


def _period(c: str) -> Column:
    return F.expr(f"({c} - pmod({c}, {PERIOD})) div {PERIOD}")


def _and_not(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """One key range: bitmaps per period of references and of parents valid throughout, and the surviving bits.

    ``group`` has at most RANGE x periods references and one row per distinct validity of a key.  Only periods with a
    reference are swept, so memory and time follow the rows, not the calendar.
    """
    refs, held = group[group["is_ref"]], group[~group["is_ref"]]
    periods, turn = np.unique(refs["lo"].to_numpy(), return_inverse=True)
    first, past = np.searchsorted(periods, held["lo"].to_numpy()), np.searchsorted(periods, held["hi"].to_numpy(), "right")
    whole = first < past
    # what begins and ends before each of the periods, in the order of periods
    at = np.r_[first[whole], past[whole]]
    order = np.argsort(at, kind="stable")
    at, bits, by = at[order], np.tile(held["bit"].to_numpy()[whole], 2)[order], np.repeat([1, -1], whole.sum())[order]
    changes = np.searchsorted(at, np.arange(len(periods) + 1))
    order = np.argsort(turn, kind="stable")
    bit_of, cuts = refs["bit"].to_numpy()[order], np.searchsorted(turn[order], np.arange(len(periods) + 1))
    valid = np.zeros(RANGE, np.int32)
    out_periods, out_maps = [], []
    for i, period in enumerate(periods):
        new = slice(changes[i], changes[i + 1])
        np.add.at(valid, bits[new], by[new])
        referred = np.zeros(RANGE, bool)
        referred[bit_of[cuts[i] : cuts[i + 1]]] = True
        left = np.packbits(referred) & ~np.packbits(valid > 0)
        if left.any():
            out_periods.append(period)
            out_maps.append(zlib.compress(left.tobytes(), 1))
    return pd.DataFrame({"range": [int(key[0])] * len(out_periods), "period": out_periods, "bitmap": out_maps})


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for r, p, m in zip(f["range"], f["period"], f["bitmap"]):
            ids = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8))) + r * RANGE
            yield pd.DataFrame({"id": ids, "period": p})


def suspects(refs: DataFrame, held: DataFrame) -> DataFrame:
    """(id, parent, ref_key, period) of the references that no parent row valid throughout the period meets."""
    asked = materialize(refs.where("at is not null").select("parent", "ref_key", _period("at").alias("period")).distinct(), "asked")
    keys = asked.select("parent", "ref_key").distinct().select(F.concat_ws("\x1f", "parent", "ref_key").alias("name"))
    dictionary, n = dense_dictionary(keys, "name")
    dictionary = materialize(dictionary, "names")
    # only keys that are referred to have a number; a parent row that no one refers to plays no part
    spans = held.select(
        F.concat_ws("\x1f", "parent", "ref_key").alias("name"),
        F.expr(f"case when since > {_NEVER - PERIOD} then null else (since - pmod(since, {PERIOD})) div {PERIOD} + if(pmod(since, {PERIOD}) = 0, 0, 1) end").alias("lo"),
        (_period("until") - 1).alias("hi"),
    )
    spans = spans.where("lo is not null and hi >= lo").distinct()
    named = asked.select(F.concat_ws("\x1f", "parent", "ref_key").alias("name"), F.col("period").alias("lo"), F.col("period").alias("hi"), F.lit(True).alias("is_ref")).unionByName(spans.withColumn("is_ref", F.lit(False)))
    encoded = lookup(named, "name", dictionary, n, "id").where("id is not null")
    bits = encoded.select(F.expr(f"id div {RANGE}").alias("range"), F.expr(f"cast(id % {RANGE} as int)").alias("bit"), "lo", "hi", "is_ref")
    parts = max(1, min(slots(refs.sparkSession), n // RANGE + 1))
    maps = bits.repartition(parts, "range").groupBy("range").applyInPandas(_and_not, "range bigint, period bigint, bitmap binary")
    left = maps.mapInPandas(_decode, "id bigint, period bigint").join(dictionary, "id")
    split = F.split("name", "\x1f", 2)
    return left.select("id", F.get(split, F.lit(0)).alias("parent"), F.get(split, F.lit(1)).alias("ref_key"), "period")


def orphans(graph_edges: DataFrame, leads: DataFrame, scores: DataFrame, graph_nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Unmet references: table_name, field_name, row_key, ref_key, load_month, absence; distinct.

    A reference is met if some parent row with its key has loaded_at <= the referring row's loaded_at and
    retired_at null or later than it.  absence is ``missing`` without any parent row, ``late`` if all parent rows
    were loaded later, else ``deleted``.  Null and blank references are none.  A referring row without
    loaded_at is met by any parent row and otherwise ``missing`` with a null month; a parent row without
    loaded_at exists but is never loaded in time.  Row keys may be null.  Empty tables, repeated rows and
    further columns are allowed.
    """
    refs = references(graph_edges, leads, scores)
    held = materialize(parents(graph_nodes, entities), "parents")
    open_ = materialize(suspects(refs, held), "suspects")
    # references of the surviving keys and periods; these and their parents' events in the period are swept in time
    nil = lambda kind: F.lit(None).cast(kind)
    names = ("table_name", "field_name", "row_key", "ref_key")
    asked = refs.withColumn("period", _period("at")).join(open_, ["parent", "ref_key", "period"])
    asked = asked.select("id", "period", "at", F.lit(1).alias("turn"), nil("bigint").alias("until"), *names, nil("boolean").alias("has_parent"))
    keys = open_.select("id", "parent", "ref_key").distinct()
    of_keys = materialize(held.join(keys, ["parent", "ref_key"]).select("id", _period("since").alias("period"), F.col("since").alias("at"), "until"), "held")
    # what earlier periods bring into a period: the latest end of all parents loaded before it
    marks = of_keys.select("id", "period", "until", F.lit(False).alias("open")).unionByName(open_.select("id", "period", nil("bigint").alias("until"), F.lit(True).alias("open")))
    marks = marks.groupBy("id", "period").agg(F.max("until").alias("until"), F.max("open").alias("open"))
    before = Window.partitionBy("id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = marks.select("id", "period", "open", F.max("until").over(before).alias("until"), F.max("until").over(whole).isNotNull().alias("has_parent")).where("open")
    start = carried.select("id", "period", F.lit(-_NEVER).alias("at"), F.lit(0).alias("turn"), "until", *(nil("string").alias(c) for c in names), "has_parent")
    within = of_keys.join(open_.select("id", "period"), ["id", "period"], "left_semi").select("id", "period", "at", F.lit(0).alias("turn"), "until", *(nil("string").alias(c) for c in names), nil("boolean").alias("has_parent"))
    events = within.unionByName(start).unionByName(asked)
    sweep = Window.partitionBy("id", "period").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("latest", F.max("until").over(sweep)).withColumn("known", F.max("has_parent").over(sweep)).where("turn = 1")
    absence = F.when(~F.col("known"), "missing").when(F.col("latest").isNull(), "late").otherwise("deleted")
    unmet = swept.where("latest is null or latest <= at")
    timed = unmet.select(*names, F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("load_month"), absence.alias("absence"))
    untimed = refs.where("at is null").join(held, ["parent", "ref_key"], "left_anti")
    untimed = untimed.select("table_name", "field_name", "row_key", "ref_key", nil("string").alias("load_month"), F.lit("missing").alias("absence"))
    return timed.unionByName(untimed).distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """Number of unmet references per table, field, month and absence."""
    return found.groupBy("table_name", "field_name", "load_month", "absence").agg(F.count("*").alias("n"))
