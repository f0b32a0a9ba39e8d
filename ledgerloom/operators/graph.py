"""The property graph of entities, hosts and networks, neighbourhoods in it and its integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize


def tx_entity(tx: DataFrame, owners: DataFrame) -> DataFrame:
    """(txid, entity_id) by the first input address."""
    return tx.select("txid", F.get("input_addresses", F.lit(0)).alias("address")).where("address is not null").join(owners.select("address", "entity_id"), "address").select("txid", "entity_id")


def money_flow(tx: DataFrame, owners: DataFrame) -> DataFrame:
    """(source, target, amount, observations): outputs from one entity to another, summed.  Flows to itself are left out."""
    paid = tx.select("txid", F.explode(F.arrays_zip("output_addresses", "output_amounts")).alias("o")).select("txid", F.col("o.output_addresses").alias("address"), F.col("o.output_amounts").alias("sats"))
    # outputs of one address are combined per source before they meet the owners
    named = paid.join(tx_entity(tx, owners).withColumnRenamed("entity_id", "source"), "txid").groupBy("source", "address").agg(F.sum("sats").alias("sats"), F.count("*").alias("n"))
    met = named.join(owners.select("address", F.col("entity_id").alias("target")), "address").where("source <> target")
    return met.groupBy("source", "target").agg(F.sum("sats").alias("amount"), F.sum("n").alias("observations"))


def first_seen_from(l2: DataFrame, of_tx: DataFrame) -> DataFrame:
    """(entity_id, src_ip, asn, geo_country, n): which hosts an entity's transactions were first seen from."""
    first = l2.where("arrival_rank = 1 and src_ip is not null").select("txid", "src_ip", "asn", "geo_country")
    seen = first.join(of_tx, "txid")
    return seen.groupBy("entity_id", "src_ip").agg(F.min(F.struct(F.col("asn").isNull().alias("x"), F.col("asn").alias("asn"))).alias("a"), F.min("geo_country").alias("geo_country"), F.count("*").alias("n")).select("entity_id", "src_ip", F.col("a.asn").alias("asn"), "geo_country", "n")


def build(tx: DataFrame, l2: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, name, weight) and edges (id, label, source, target, amount, observations).

    The weight of an entity is its addresses, of a host its largest count with one entity, of a network 0.  An id
    is given to one node, entities before hosts before networks.  Edge ids follow (label, source, target).
    """
    flow = money_flow(tx, owners)
    seen = materialize(first_seen_from(l2, tx_entity(tx, owners)), "seen")
    hosts = seen.groupBy("src_ip").agg(F.max(F.struct("n", "entity_id", "asn", "geo_country")).alias("b"))
    hosts = hosts.select("src_ip", F.col("b.n").alias("n"), F.concat(F.lit("AS"), F.coalesce(F.col("b.asn").cast("string"), F.lit(""))).alias("network"), F.col("b.geo_country").alias("country"))
    entity_nodes = owners.groupBy("entity_id").agg(F.count("*").alias("weight")).select(F.col("entity_id").alias("id"), F.lit("ENTITY").alias("label"), F.col("entity_id").alias("name"), "weight", F.lit(0).alias("rank"))
    host_nodes = hosts.select(F.col("src_ip").alias("id"), F.lit("IP").alias("label"), F.col("src_ip").alias("name"), F.col("n").alias("weight"), F.lit(1).alias("rank"))
    networks = hosts.groupBy("network").agg(F.min_by("country", F.when(F.col("country").isNotNull(), F.col("src_ip"))).alias("country"))
    network_nodes = networks.select(F.col("network").alias("id"), F.lit("ASN").alias("label"), F.concat("network", F.lit(" ("), F.coalesce("country", F.lit("")), F.lit(")")).alias("name"), F.lit(0).cast("bigint").alias("weight"), F.lit(2).alias("rank"))
    every = entity_nodes.unionByName(host_nodes).unionByName(network_nodes)
    nodes = every.groupBy("id").agg(F.min_by(F.struct("label", "name", "weight"), "rank").alias("x")).select("id", "x.*")
    zero = F.lit(0).cast("bigint")
    edges = flow.select(F.lit("SENT_TO").alias("label"), "source", "target", "amount", "observations")
    edges = edges.unionByName(seen.select(F.lit("SEEN_FROM").alias("label"), F.col("entity_id").alias("source"), F.col("src_ip").alias("target"), zero.alias("amount"), F.col("n").alias("observations")))
    edges = edges.unionByName(hosts.select(F.lit("IN_ASN").alias("label"), F.col("src_ip").alias("source"), F.col("network").alias("target"), zero.alias("amount"), zero.alias("observations")))
    ident = F.concat(F.lit("e"), F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "label", "source", "target"), 256), 1, 15), 16, 10))
    return nodes, edges.select(ident.alias("id"), "label", "source", "target", "amount", "observations")


#: Nodes of a fringe that are broadcast at most.
BROADCAST_FRINGE = 200_000


def reach(edges: DataFrame, focus: DataFrame, hops: int) -> DataFrame:
    """(id, depth): nodes within ``hops`` undirected edges of those of ``focus`` (column id), and the least depth.

    Each hop filters the edges by the fringe, in both directions; the edge table is neither doubled nor written.
    """
    found = focus.select("id", F.lit(0).alias("depth")).distinct()
    fringe = found
    for depth in range(1, hops + 1):
        ids = fringe.select("id")
        ids = F.broadcast(ids) if depth == 1 or fringe.count() <= BROADCAST_FRINGE else ids
        ways = (edges.select(F.col(a).alias("id"), F.col(b).alias("to")).join(ids, "id", "left_semi").select(F.col("to").alias("id")) for a, b in (("source", "target"), ("target", "source")))
        further = reduce(DataFrame.union, ways).where("id is not null").distinct().join(found.select("id"), "id", "left_anti")
        fringe = materialize(further.select("id", F.lit(depth).alias("depth")), "fringe")
        found = found.unionByName(fringe)
    return found


def capped(found: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` nodes by depth, then id; a reach that is shown on a screen."""
    return found.orderBy("depth", "id").limit(cap)


def induced(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``found`` and the edges between them."""
    ids = found.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inner


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that no node has (null ends included), once each: id, source, target."""
    ids = nodes.select("id").where("id is not null").distinct()
    ends = edges.select("id", "source", "target").distinct()
    missing = [ends.join(ids.withColumnRenamed("id", e), e, "left_anti").select("id", "source", "target") for e in ("source", "target")]
    return reduce(DataFrame.union, missing).distinct()


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: a JSON document {nodes: [{data}], edges: [{data}]} of a bounded neighbourhood."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(F.struct("id", "label", "name", "weight").alias("data")))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.struct("id", "label", "source", "target", "amount", "observations").alias("data")))).alias("edges"))
    # two rows of one cell each
    both = n.select("nodes", F.lit(None).cast(e.schema["edges"].dataType).alias("edges")).unionByName(e.select(F.lit(None).cast(n.schema["nodes"].dataType).alias("nodes"), "edges"))
    return both.agg(F.to_json(F.struct(F.max("nodes").alias("nodes"), F.max("edges").alias("edges"))).alias("elements"))


def ranked_nodes(nodes: DataFrame, top: int) -> DataFrame:
    """The ``top`` nodes by weight."""
    return nodes.orderBy(F.desc_nulls_last("weight"), "id").limit(top)


def first_writing(nodes: DataFrame) -> DataFrame:
    """One row per id: the first writing by label, then time of loading."""
    w = Window.partitionBy("id").orderBy(F.col("loaded_at").asc_nulls_last(), "label", F.col("name").asc_nulls_last(), F.col("weight").asc_nulls_last())
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
