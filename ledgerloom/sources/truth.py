"""The truth beside generated evidence: who owns which addresses.  For labels and for scoring only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "clusters array<struct<actor_id:string,kind:string,illicit:boolean,origin_ips:array<string>,addresses:array<string>>>, tx_origin_actor map<string,string>, "
    "change_addresses map<string,string>, peeling_chains array<struct<txids:array<string>>>, coinjoins array<string>"
)


def write_truth(truth: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(truth, f)


def owners(spark: SparkSession, path: str) -> DataFrame:
    """(address, actor_id, kind, illicit), one row per address of an actor."""
    doc = spark.read.json(path, schema=SCHEMA, multiLine=True)
    return doc.select(F.explode("clusters").alias("c")).select(F.explode("c.addresses").alias("address"), "c.actor_id", "c.kind", "c.illicit")


def origins(spark: SparkSession, path: str) -> DataFrame:
    """(txid, actor_id): who sent a transaction."""
    doc = spark.read.json(path, schema=SCHEMA, multiLine=True)
    return doc.select(F.explode("tx_origin_actor").alias("txid", "actor_id"))


def labels(entities: DataFrame, owned: DataFrame) -> DataFrame:
    """(entity_id, label): 1 if the actor that owns most of an entity's addresses is illicit."""
    from ..operators.evaluation import majority

    by = majority(entities.join(owned.select("address", "actor_id"), "address"), "entity_id", "actor_id")
    return by.join(owned.select("actor_id", "illicit").distinct(), "actor_id").select("entity_id", F.col("illicit").cast("int").alias("label"))
