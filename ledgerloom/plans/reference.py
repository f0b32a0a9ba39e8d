"""Queries of the ledger and network operators over the project's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import display
from ..keys import clean_address, clean_id
from ..operators import attribution, chains, change, cospend, entities, evaluation, features, feature_blocks, forest, graph, mixing, observations
from ..serve import Store, latest
from ..shared import materialize
from ..sources import geo
from .problems import table

L2_COLUMNS = ["txid", "ts_micro", "src_ip", "src_port", "dst_ip", "dst_port", "geo_country", "asn", "asn_org", "country_source", "asn_source", "arrival_rank"]

#: Features in satoshis and the decimals they are shown with; others have six.
SATOSHIS, SATOSHI_DIGITS = ("total_out", "mean_value", "median_value", "value_spread", "mean_fee", "fee_spread"), 1

#: Documentation and test ranges with invented owners, for the lookup by longest prefix.
RANGES = [
    ("10.0.0.0/8", "ZZ", None, None),
    ("10.1.0.0/16", None, 64600, "Example Net"),
    ("10.1.128.0/17", "YY", 64601, "Example Upper"),
    ("10.1.200.0/24", "XX", None, None),
    ("192.0.2.0/24", "WW", 64602, "Example Doc"),
    ("198.18.0.0/15", "VV", 64603, "Example Bench"),
    ("2001:db8::/32", "UU", None, None),
    ("2001:db8:1::/48", None, 64604, "Example Six"),
    ("2001:db8:1:70::/60", "TT", 64605, "Example Narrow"),
    ("fd00::/8", "SS", 64606, "Example Local"),
]


def _tx(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tx_l1").where("txid is not null").dropDuplicates(["txid"])


def _l2(s: SparkSession, d: str) -> DataFrame:
    # partitioned by txid, which serves the distinct and what follows by txid alike: one shuffle
    return table(s, d, "net_l2").repartition("txid").distinct()


def _owners(s: SparkSession, d: str) -> DataFrame:
    return feature_blocks.address_entities(table(s, d, "entities"))


def _sightings(s: SparkSession, d: str) -> DataFrame:
    l2 = table(s, d, "net_l2")
    return l2.select("txid", clean_id("src_ip").alias("src_ip"), "arrival_rank", "asn", F.col("geo_country").alias("country")).distinct()


def _tx_entity(s: SparkSession, d: str) -> DataFrame:
    return graph.tx_entity(_tx(s, d).select("txid", F.array(clean_address(F.get("input_addresses", F.lit(0)))).alias("input_addresses")), _owners(s, d))


#: Thresholds under which small tables hold positive and negative cases of mixing, chains and leads; queries named ..._low use them.
LOW = {"MIN_EQUAL_OUTPUTS": 1, "MIN_CHAIN_LENGTH": 2, "LAUNDERING_MIN_HOPS": 2, "LAUNDERING_MAX_MEDIAN_PEEL": 0.2, "LAUNDERING_MAX_SPREAD": 0.2, "SIGNIFICANCE": 0.5}


def _mixing(tx: DataFrame, low: bool = False) -> DataFrame:
    return mixing.classify(tx, min_equal=LOW["MIN_EQUAL_OUTPUTS"]) if low else mixing.classify(tx)


def _flags(s: SparkSession, d: str, low: bool = False) -> DataFrame:
    return _mixing(_tx(s, d), low)


def _detected(tx: DataFrame, low: bool = False) -> DataFrame:
    laundering = LOW["LAUNDERING_MIN_HOPS"], LOW["LAUNDERING_MAX_MEDIAN_PEEL"], LOW["LAUNDERING_MAX_SPREAD"]
    return chains.detect(tx, LOW["MIN_CHAIN_LENGTH"], laundering) if low else chains.detect(tx)


def _chains(s: SparkSession, d: str, low: bool = False) -> DataFrame:
    tx = materialize(_tx(s, d).select("txid", "ts_micro", "input_addresses", "output_addresses", "output_amounts", "n_inputs", "n_outputs"), "tx")
    return chains.with_entities(_detected(tx, low), _owners(s, d))


def _store(s: SparkSession, d: str, with_chains: bool = False, low: bool = False) -> Store:
    """Tables of the store; those that a query does not touch are never read."""
    owners = table(s, d, "entities").select(clean_address("address").alias("address"), clean_id("entity_id").alias("entity_id"), clean_id("cluster_id").alias("cluster_id")).where("address is not null and entity_id is not null")
    owners = owners.groupBy("address").agg(F.min("entity_id").alias("entity_id"), F.min("cluster_id").alias("cluster_id"))
    return Store(_tx(s, d), _l2(s, d), owners, _chains(s, d, low) if with_chains else None, _flags(s, d, low), latest(table(s, d, "leads"), "entity_id"), latest(table(s, d, "scores"), "entity_id"), graph.first_writing(table(s, d, "graph_nodes")), table(s, d, "graph_edges").distinct())


def _busiest(store: Store) -> str:
    """The entity with the most addresses: the subject of the detail queries."""
    by = store.owners.groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(1).collect()
    return by[0]["entity_id"] if by else ""


# observations and ledger


def keep_first_observation(s, d):
    return observations.keep_first(table(s, d, "net_l2"), ["txid", "ts_micro", "src_ip"], [c for c in L2_COLUMNS if c not in ("txid", "ts_micro", "src_ip")])


def duplicate_counts(s, d):
    return observations.duplicate_count(table(s, d, "net_l2"), ["txid", "ts_micro", "src_ip"])


def arrival_ranks(s, d):
    return observations.arrival_rank(_l2(s, d)).select("txid", "ts_micro", "src_ip", "rank")


def earliest_observation(s, d):
    return observations.earliest(table(s, d, "net_l2"), columns=["ts_micro", "src_ip", "src_port", "dst_ip"])


def derived_totals(s, d):
    return observations.derived_totals(_tx(s, d))


def conservation_check(s, d):
    return observations.conservation(table(s, d, "tx_l1"))


def provenance_counts(s, d):
    return observations.provenance_counts(table(s, d, "net_l2"))


def geo_enrich(s, d):
    known = s.createDataFrame(RANGES, "cidr string, country string, asn bigint, asn_org string")
    return geo.enrich(_l2(s, d), known).select("txid", "src_ip", "arrival_rank", "ts_micro", "geo_country", "asn", "asn_org", "country_source", "asn_source")


def seen_and_booked(s, d):
    """txids that both layers have."""
    return table(s, d, "tx_l1").select("txid").intersect(table(s, d, "net_l2").select("txid"))


def seen_only(s, d):
    """txids that were seen and that the ledger lacks."""
    return table(s, d, "net_l2").select("txid").subtract(table(s, d, "tx_l1").select("txid"))


def lead_rows(s, d):
    """Leads as they are shown."""
    led = latest(table(s, d, "leads"), "entity_id")
    return led.select("entity_id", display.shortened(F.col("entity_id")).alias("short_id"), display.ratio(F.col("hits"), F.col("transactions")).alias("first_relays"), display.network(F.col("asn")).alias("network"), F.coalesce("country", F.lit(display.NOTHING)).alias("country"))


def sampled_transactions(s, d):
    """A sample of 60 transactions: the sampling operator, seeded by a hash of the txid."""
    return _tx(s, d).select("txid", "ts_micro").orderBy(F.md5(F.concat(F.lit("sample-42-"), "txid"))).limit(60)


# clusters


def coinjoin_flags(s, d):
    return _flags(s, d)


def change_guesses(s, d):
    return change.guesses(_tx(s, d))


def first_seen_spent(s, d):
    tx = _tx(s, d).where("ts_micro is not null")
    return change.first_seen(tx).join(change.first_spent(tx), "address", "left").select("address", F.col("seen.ts_micro").alias("seen_at"), F.col("seen.txid").alias("seen_in"), "spent_at")


def cospend_clusters(s, d):
    return cospend.cospend_groups(_tx(s, d), _flags(s, d))


def cluster_ids(s, d):
    return cospend.cluster_table(cospend_clusters(s, d))


def budgeted_clusters(s, d):
    tx = materialize(_tx(s, d), "tx")
    flags = materialize(change.transaction_flags(tx), "flags")
    return cospend.budgeted_merge(tx, flags, materialize(cospend.cospend_groups(tx, flags), "groups"))


# chains, entities and graph


def peel_successors(s, d):
    return chains.successors(_tx(s, d))


def peel_chains(s, d):
    return _chains(s, d)


def chain_steps(s, d):
    return chains.consecutive(_chains(s, d))


def folded_entities(s, d, low=False):
    tx = materialize(_tx(s, d), "tx")
    groups = materialize(cospend.cospend_groups(tx, _mixing(tx, low)), "groups")
    return entities.fold(groups, _detected(tx, low))


def money_flow(s, d):
    return graph.money_flow(_tx(s, d), _owners(s, d))


def first_seen_from(s, d):
    return graph.first_seen_from(_sightings_l2(s, d), _tx_entity(s, d))


def _sightings_l2(s, d):
    return _sightings(s, d).withColumnRenamed("country", "geo_country")


def built_nodes(s, d):
    return graph.build(_tx(s, d), _sightings_l2(s, d), _owners(s, d))[0]


def built_edges(s, d):
    return graph.build(_tx(s, d), _sightings_l2(s, d), _owners(s, d))[1].drop("id")


def k_hop(s, d):
    edges = table(s, d, "graph_edges").select(clean_id("source").alias("source"), clean_id("target").alias("target"))
    focus = table(s, d, "graph_edges").where("label = 'SENT_TO'").groupBy(clean_id("source").alias("id")).agg(F.count("*").alias("n")).where("id is not null").orderBy(F.desc("n"), "id").limit(1)
    return graph.reach(edges, focus.select("id"), 2)


def dangling_edges(s, d):
    clean = table(s, d, "graph_edges").select("id", clean_id("source").alias("source"), clean_id("target").alias("target"))
    return graph.dangling_edges(table(s, d, "graph_nodes").select(clean_id("id").alias("id")), clean)


def top_nodes(s, d):
    return graph.ranked_nodes(graph.first_writing(table(s, d, "graph_nodes")).select("id", "label", "weight"), 20)


def large_entity_transactions(s, d):
    of = _tx_entity(s, d)
    large = of.groupBy("entity_id").agg(F.count("*").alias("n")).where("n >= 10").select("entity_id")
    return of.join(large, "entity_id", "left_semi").select("txid", "entity_id")


# attribution and features


def origin_leads(s, d):
    found = attribution.leads(_sightings(s, d), _tx_entity(s, d))
    p = lambda c: F.round(F.log10(F.greatest(F.col(c), F.lit(1e-300))), 4)
    return found.select("entity_id", "ip", "hits", "transactions", F.round("rank_weight", 6).alias("rank_weight"), F.round("baseline", 9).alias("baseline"), p("p_value").alias("log_p"), p("adjusted_p").alias("log_adjusted_p"), "significant", "tests")


def best_leads(s, d):
    return attribution.best_per_entity(attribution.leads(_sightings(s, d), _tx_entity(s, d))).select("entity_id", "ip", "asn", "country", "hits", "transactions", "significant")


def geo_concentration(s, d):
    c = attribution.geo_concentration(_sightings(s, d), _tx_entity(s, d))
    return c.select("entity_id", "n_countries", "n_asns", F.round("top_country_share", 9).alias("top_country_share"), F.round("top_asn_share", 9).alias("top_asn_share"))


def permutation_null(s, d):
    """Significant leads with the true owners and with shuffled ones."""
    sightings, of = materialize(_sightings(s, d), "sightings"), materialize(_tx_entity(s, d), "owners")
    true = attribution.leads(sightings, of).agg(F.count("*").alias("tested"), F.count_if("significant").alias("significant")).withColumn("owners", F.lit("true"))
    null = attribution.leads(sightings, attribution.shuffled_owners(of, K.SEED)).agg(F.count("*").alias("tested"), F.count_if("significant").alias("significant")).withColumn("owners", F.lit("shuffled"))
    return true.unionByName(null)


def _features(s, d):
    tx = materialize(_tx(s, d), "tx")
    owners = materialize(_owners(s, d), "owners")
    found = chains.with_entities(chains.detect(tx), owners).where("hop = 0")
    leads = table(s, d, "leads").withColumn("entity_id", clean_id("entity_id"))
    return features.extract(tx, owners, mixing.classify(tx), found, leads)


def entity_features(s, d):
    f = _features(s, d)
    return f.select("entity_id", *(F.round(c, SATOSHI_DIGITS if c in SATOSHIS else 6).alias(c) for c in f.columns[1:]))


def majority_cluster(s, d):
    owners = _owners(s, d)
    clusters = table(s, d, "clusters").select(clean_address("address").alias("address"), clean_id("cluster_id").alias("cluster_id")).distinct()
    return evaluation.majority(owners.join(clusters, "address"), "entity_id", "cluster_id")


def pairwise_scores(s, d):
    clusters = table(s, d, "clusters").select(clean_address("address").alias("address"), clean_id("cluster_id").alias("cluster_id")).where("address is not null and cluster_id is not null").groupBy("address").agg(F.min("cluster_id").alias("cluster_id"))
    r = evaluation.pairwise_scores(_owners(s, d).join(clusters, "address"), "cluster_id", "entity_id")
    return r.select(*(F.round(c, 9).alias(c) for c in r.columns))


def risk_metrics(s, d):
    r = evaluation.classification(latest(table(s, d, "scores"), "entity_id"), "risk_score", "label")
    return r.select("n", *(F.round(c, 9).alias(c) for c in r.columns[1:]))


# serving


def alerts(s, d):
    return _store(s, d, True).alerts()


def alerts_filtered(s, d):
    return _store(s, d, True).filtered_alerts(0.25, ["High", "Critical"], attributed=True).select("entity_id", "risk_score", "ip", "n_addresses")


def risk_factors(s, d):
    return _store(s, d).exploded_factors()


def entity_addresses(s, d):
    st = _store(s, d)
    return st.entity_addresses(_busiest(st))


def entity_transactions(s, d):
    st = _store(s, d)
    return st.entity_transactions(_busiest(st))


def entity_chains(s, d):
    st = _store(s, d, True)
    return st.entity_chains(_busiest(st))


def entity_candidates(s, d):
    st = _store(s, d)
    return st.entity_candidates(_busiest(st))


def entity_observations(s, d):
    st = _store(s, d)
    return st.observations(_busiest(st))


def subgraph_nodes(s, d):
    st = _store(s, d)
    return st.subgraph(_busiest(st))[0]


def subgraph_edges(s, d):
    st = _store(s, d)
    return st.subgraph(_busiest(st))[1]


def subgraph_elements(s, d):
    st = _store(s, d)
    focus = s.createDataFrame([(_busiest(st),)], "id string")
    found = materialize(graph.capped(graph.reach(st.edges, focus, 1), 60), "found")
    return graph.elements(*graph.induced(st.nodes, st.edges, found))


def summary_totals(s, d):
    return _store(s, d, True).summary()


def geo_rollup(s, d):
    return _store(s, d).geo_rollup().withColumn("mean_risk", F.round("mean_risk", 9))


def risk_bands(s, d):
    return _store(s, d).risk_bands()


def countries(s, d):
    return _store(s, d).countries()


def networks_topk(s, d):
    return _store(s, d).networks().withColumn("mean_risk", F.round("mean_risk", 9))


def hourly_activity(s, d):
    return _store(s, d).hourly_activity()


def hourly_long(s, d):
    return _store(s, d).hourly_long()


def chain_list(s, d):
    return _store(s, d, True).chain_list()


def longest_chain(s, d):
    return _store(s, d, True).longest_chain()


def chain_hops(s, d):
    st = _store(s, d, True)
    first = st.chain_list().limit(1).collect()
    return st.chain_hops(first[0]["chain_id"] if first else "")


def coinjoins(s, d):
    return _store(s, d).coinjoins()


def pipeline_stats(s, d):
    return _store(s, d, True).pipeline_stats()


def attributed_hosts(s, d):
    return _store(s, d).attributed()

# with low thresholds


def coinjoin_flags_low(s, d):
    return _flags(s, d, True)


def coinjoins_low(s, d):
    return _store(s, d, low=True).coinjoins()


def peel_chains_low(s, d):
    return _chains(s, d, True)


def chain_steps_low(s, d):
    return chains.consecutive(_chains(s, d, True))


def folded_entities_low(s, d):
    return folded_entities(s, d, True)


def best_leads_low(s, d):
    found = attribution.leads(_sightings(s, d), _tx_entity(s, d), significance=LOW["SIGNIFICANCE"])
    return attribution.best_per_entity(found).select("entity_id", "ip", "hits", "transactions", "significant")


def alerts_low(s, d):
    return _store(s, d, True, True).alerts()


def alerts_laundering_low(s, d):
    return _store(s, d, True, True).filtered_alerts(laundering=True).select("entity_id", "risk_score", "chain_hops", "laundering_like")


def entity_chains_low(s, d):
    """Chains of the entity with the longest one."""
    st = _store(s, d, True, True)
    first = st.chains.where("hop = 0 and entity_id is not null").orderBy(F.desc("hops"), "start").limit(1).collect()
    return st.entity_chains(first[0]["entity_id"] if first else "")


def chain_list_low(s, d):
    return _store(s, d, True, True).chain_list()


def chain_hops_low(s, d):
    st = _store(s, d, True, True)
    first = st.chain_list().limit(1).collect()
    return st.chain_hops(first[0]["chain_id"] if first else "")


# models


def _labelled(s, d):
    """Features of every scored entity with the label of its scores; an entity without a label is scored, not learnt from."""
    labels = latest(table(s, d, "scores"), "entity_id").select("entity_id", "label")
    return materialize(_features(s, d).join(labels, "entity_id", "left"), "labelled")


def forest_scores(s, d):
    rows = _labelled(s, d)
    return forest.predict(forest.fit(rows), rows).select("entity_id", "risk_score", "label")


def forest_importances(s, d):
    return s.createDataFrame(forest.importances(forest.fit(_labelled(s, d))), "feature string, `group` string, importance double")


def forest_metrics(s, d):
    return forest.metrics(_labelled(s, d))


def forest_ablation(s, d):
    return forest.ablation(_labelled(s, d))


def forest_null(s, d):
    """Metrics with the labels dealt to other entities, the mean over seeds."""
    return forest.label_null(_labelled(s, d))


def forest_stability(s, d):
    return forest.seed_stability(_labelled(s, d))


def isolation_scores(s, d):
    return forest.isolation_scores(_features(s, d))


def shap_factors(s, d):
    rows = _labelled(s, d)
    return forest.explain(forest.fit(rows), rows).select("entity_id", F.inline("factors"))


def score_table(s, d):
    return forest.score_table(_labelled(s, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        keep_first_observation, duplicate_counts, arrival_ranks, earliest_observation, derived_totals, conservation_check, provenance_counts, geo_enrich, seen_and_booked, seen_only, lead_rows, sampled_transactions,
        coinjoin_flags, change_guesses, first_seen_spent, cospend_clusters, cluster_ids, budgeted_clusters,
        peel_successors, peel_chains, chain_steps, folded_entities, money_flow, first_seen_from, built_nodes, built_edges, k_hop, dangling_edges, top_nodes, large_entity_transactions,
        origin_leads, best_leads, geo_concentration, permutation_null, entity_features, majority_cluster, pairwise_scores, risk_metrics,
        alerts, alerts_filtered, risk_factors, entity_addresses, entity_transactions, entity_chains, entity_candidates, entity_observations, subgraph_nodes, subgraph_edges, subgraph_elements,
        summary_totals, geo_rollup, risk_bands, countries, networks_topk, hourly_activity, hourly_long, chain_list, longest_chain, chain_hops, coinjoins, pipeline_stats, attributed_hosts,
        coinjoin_flags_low, coinjoins_low, peel_chains_low, chain_steps_low, folded_entities_low, best_leads_low, alerts_low, alerts_laundering_low, entity_chains_low, chain_list_low, chain_hops_low,
        forest_scores, forest_importances, forest_metrics, forest_ablation, forest_null, forest_stability, isolation_scores, shap_factors, score_table,
    )
}
