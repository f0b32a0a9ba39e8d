"""The read API over the store's tables; each query is a function of the tables and returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import constants as K
from .keys import clean_id
from .operators import graph as G
from .sources import files

FACTORS = "array<struct<name:string,`group`:string,contribution:double>>"


def latest(rows: DataFrame, key: str) -> DataFrame:
    """One row per non-blank key: the one loaded last (rows that repeat it are equal)."""
    clean = rows.withColumn(key, clean_id(key)).where(F.col(key).isNotNull())
    w = Window.partitionBy(key).orderBy(F.col("loaded_at").desc_nulls_last())
    return clean.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def side_by_side(totals: list[DataFrame]) -> DataFrame:
    """Rows of totals (bigint columns, one row each) as one row; they meet in a single aggregate, not in a join."""
    names = [c for t in totals for c in t.columns]
    long_ = reduce(DataFrame.unionByName, (t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n")) for c in t.columns))).alias("x")).select("x.*") for t in totals))
    return long_.agg(*(F.max(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in names))


def risk_band(score: Column) -> Column:
    """The band of a risk score."""
    out = F.lit(K.LOWEST_BAND)
    for least, name in reversed(K.RISK_BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


@dataclass
class Store:
    """Tables of the store.  scores and leads have one row per entity, owners one per address, tx one per txid,
    chains one per chain and hop, flags one per txid."""

    tx: DataFrame
    l2: DataFrame
    owners: DataFrame
    chains: DataFrame
    flags: DataFrame
    leads: DataFrame
    scores: DataFrame
    nodes: DataFrame
    edges: DataFrame
    manifest: DataFrame | None = None

    def _tx_entity(self) -> DataFrame:
        return G.tx_entity(self.tx, self.owners)

    def _chain_heads(self) -> DataFrame:
        return self.chains.where("hop = 0")

    def alerts(self) -> DataFrame:
        """The ranked queue: risk descending, then confidence descending (nulls last), then entity_id."""
        chain = self._chain_heads().where("entity_id is not null").groupBy("entity_id").agg(F.max("hops").alias("chain_hops"), F.bool_or("laundering_like").alias("laundering_like"))
        size = self.owners.groupBy("entity_id").agg(F.count("*").alias("n_addresses"))
        lead = self.leads.select("entity_id", "ip", "country", "asn", "hits", "transactions", F.col("confidence").alias("attribution_confidence"), F.col("significant").alias("attribution_significant"), "n_countries")
        out = self.scores.select("entity_id", "risk_score", "is_anomaly", "factors").join(lead, "entity_id", "left").join(chain, "entity_id", "left").join(size, "entity_id", "left")
        out = out.withColumn("chain_hops", F.coalesce("chain_hops", F.lit(0))).withColumn("laundering_like", F.coalesce("laundering_like", F.lit(False)))
        return out.orderBy(F.desc_nulls_last("risk_score"), F.desc_nulls_last("attribution_confidence"), "entity_id")

    def filtered_alerts(self, least_risk: float = 0.0, bands: list[str] | None = None, attributed: bool = False, laundering: bool = False) -> DataFrame:
        """Alerts by least risk, bands, and whether attributed or laundering-like (a null counts as not)."""
        out = self.alerts().where(F.col("risk_score") >= least_risk)
        if bands:
            out = out.where(risk_band(F.col("risk_score")).isin(bands))
        if attributed:
            out = out.where(F.coalesce("attribution_significant", F.lit(False)))
        return out.where("laundering_like") if laundering else out

    def exploded_factors(self) -> DataFrame:
        """(entity_id, name, group, contribution) from the JSON of the scores; null and broken JSON give nothing."""
        return self.scores.select("entity_id", F.inline(F.from_json("factors", FACTORS)))

    def entity_addresses(self, entity_id: str) -> DataFrame:
        return self.owners.where(F.col("entity_id") == entity_id).select("address").orderBy("address")

    def entity_transactions(self, entity_id: str) -> DataFrame:
        mine = self._tx_entity().where(F.col("entity_id") == entity_id).select("txid")
        return self.tx.join(mine, "txid", "left_semi").select("txid", "ts_micro", "total_out", "fee", "n_inputs", "n_outputs", "script_type").orderBy(F.asc_nulls_last("ts_micro"), "txid")

    def entity_chains(self, entity_id: str) -> DataFrame:
        mine = self._chain_heads().where(F.col("entity_id") == entity_id)
        return mine.select("chain_id", "hops", F.col("peeled_sats").alias("peeled"), "median_peel", "laundering_like", "start").orderBy(F.desc("hops"), "start").drop("start")

    def entity_candidates(self, entity_id: str) -> DataFrame:
        return self.leads.where(F.col("entity_id") == entity_id).select("ip", "country", "asn", "hits", "transactions", "confidence", "adjusted_p", "significant").orderBy("adjusted_p")

    def observations(self, entity_id: str, limit: int = 400) -> DataFrame:
        """Sightings of an entity's transactions in order of time, the first ``limit``."""
        mine = self._tx_entity().where(F.col("entity_id") == entity_id).select("txid")
        rows = self.l2.join(mine, "txid", "left_semi").select("txid", "src_ip", "arrival_rank", "ts_micro", "geo_country", "asn").distinct()
        return rows.orderBy(F.asc_nulls_last("ts_micro"), "txid", "arrival_rank", "src_ip").limit(limit)

    def subgraph(self, entity_id: str, hops: int = 1, cap: int = 60) -> tuple[DataFrame, DataFrame]:
        """Nodes (id, label, name, weight, focus) and edges (id, label, source, target, btc, seen) around an entity."""
        focus = self.nodes.sparkSession.createDataFrame([(entity_id,)], "id string")
        found = G.capped(G.reach(self.edges, focus, hops), cap)
        nodes, edges = G.induced(self.nodes, self.edges, found)
        btc = F.format_string("%.4f", F.col("amount") / 1e8)
        return nodes.select("id", "label", "name", "weight", (F.col("id") == entity_id).alias("focus")), edges.select("id", "label", "source", "target", btc.alias("btc"), F.col("observations").alias("seen"))

    def summary(self) -> DataFrame:
        """One row of totals."""
        one = [
            self.tx.agg(F.count("*").alias("transactions")),
            self.l2.agg(F.count("*").alias("observations")),
            self.owners.agg(F.count("*").alias("addresses"), F.count_distinct("entity_id").alias("entities")),
            self.scores.agg(F.count("*").alias("scored"), F.count_if(F.col("risk_score") >= K.RISK_BANDS[1][0]).alias("high_risk")),
            self.leads.agg(F.count_if("significant").alias("attributed"), F.count_distinct(F.when(F.col("significant"), F.col("country"))).alias("countries")),
            self._chain_heads().agg(F.count("*").alias("chains"), F.count_if("laundering_like").alias("laundering_chains")),
        ]
        return side_by_side(one)

    def _led_scores(self) -> DataFrame:
        return self.leads.join(self.scores.select("entity_id", "risk_score"), "entity_id")

    def geo_rollup(self) -> DataFrame:
        by = self._led_scores().where("significant").groupBy("country", "asn").agg(F.count("*").alias("entities"), F.avg("risk_score").alias("mean_risk"))
        return by.orderBy(F.desc("entities"), F.asc_nulls_last("country"), F.asc_nulls_last("asn"))

    def risk_bands(self) -> DataFrame:
        return self.scores.groupBy(risk_band(F.col("risk_score")).alias("band")).agg(F.count("*").alias("n"))

    def countries(self) -> DataFrame:
        by = self._led_scores().where("significant and country is not null").groupBy("country").agg(F.count("*").alias("entities"), F.count_if(F.col("risk_score") >= K.RISK_BANDS[1][0]).alias("high_risk"))
        return by.orderBy(F.desc("entities"), "country")

    def networks(self, limit: int = 15) -> DataFrame:
        by = self._led_scores().where("significant").groupBy("asn").agg(F.min("country").alias("country"), F.count("*").alias("entities"), F.avg("risk_score").alias("mean_risk"), F.sum("hits").alias("sightings"))
        return by.orderBy(F.desc("entities"), F.asc_nulls_last("asn")).limit(limit)

    def hourly_activity(self) -> DataFrame:
        """Transactions of scored entities by hour (UTC), high risk and other."""
        rows = self.tx.where("ts_micro is not null").select("txid", F.hour(F.timestamp_micros("ts_micro")).cast("bigint").alias("hour")).join(self._tx_entity(), "txid").join(self.scores.select("entity_id", "risk_score"), "entity_id")
        high = F.coalesce(F.col("risk_score") >= K.RISK_BANDS[1][0], F.lit(False))
        return rows.groupBy("hour").agg(F.count_if(high).alias("high_risk"), F.count_if(~high).alias("other")).orderBy("hour")

    def hourly_long(self) -> DataFrame:
        """The same as (hour, kind, n), one row per cell."""
        return self.hourly_activity().unpivot("hour", ["high_risk", "other"], "kind", "n")

    def chain_list(self) -> DataFrame:
        heads = self._chain_heads().join(self.scores.select("entity_id", F.col("risk_score").alias("risk")), "entity_id", "left")
        out = heads.select("chain_id", "entity_id", "hops", F.col("peeled_sats").alias("peeled"), "median_peel", "peel_spread", "laundering_like", "risk", "start")
        return out.orderBy(F.desc("laundering_like"), F.desc("hops"), "start").drop("start")

    def longest_chain(self) -> DataFrame:
        return self._chain_heads().agg(F.max("hops").alias("hops"))

    def chain_hops(self, chain_id: str) -> DataFrame:
        mine = self.chains.where(F.col("chain_id") == chain_id).select("hop", "txid", "carried_address")
        return mine.join(self.tx.select("txid", "total_out", "fee", "ts_micro"), "txid", "left").select("hop", "txid", "carried_address", "total_out", "fee", "ts_micro").orderBy("hop")

    def coinjoins(self) -> DataFrame:
        mixed = self.flags.where("is_coinjoin").select("txid", "coinjoin_reason").join(self.tx.select("txid", "n_inputs", "n_outputs", "total_out"), "txid")
        return mixed.orderBy(F.desc("n_inputs"), "txid")

    def pipeline_stats(self) -> DataFrame:
        """(stage, tables, summary): what each stage produced."""
        n = lambda c: F.format_number(c, 0)

        heads = self._chain_heads()
        pairs = [
            (side_by_side([self.tx.agg(F.count("*").alias("a")), self.l2.agg(F.count("*").alias("b"))]), F.max("a"), F.max("b")),
            (side_by_side([self.owners.agg(F.count_distinct("cluster_id").alias("a")), self.flags.agg(F.count_if("is_coinjoin").alias("b"))]), F.max("a"), F.max("b")),
            (side_by_side([self.owners.agg(F.count_distinct("entity_id").alias("a")), heads.agg(F.count("*").alias("b"))]), F.max("a"), F.max("b")),
            (self.leads, F.count_if("significant"), F.count("*")),
            (self.scores, F.count("*"), F.count_if("is_anomaly")),
        ]
        lines = (df.agg(F.format_string(text, n(a), n(b)).alias("summary")).select(F.lit(stage).alias("stage"), F.lit(tables).alias("tables"), "summary") for (df, a, b), (stage, tables, text) in zip(pairs, K.STAGE_REPORT))
        return reduce(DataFrame.unionByName, lines)

    def attributed(self) -> DataFrame:
        """Significant leads, and whether the entity's traffic rotates between countries."""
        return self.leads.where("significant").select("entity_id", "ip", "country", "asn", (F.coalesce("n_countries", F.lit(0)) > 1).alias("rotating"))


def catalog(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Register the tables of ``names`` that exist in a folder as views; which they are."""
    found = []
    for name in names:
        path = f"{folder}/{name}.parquet"
        if files.exists(spark, path):
            spark.read.parquet(path).createOrReplaceTempView(name)
            found.append(name)
    return found


def custody(spark: SparkSession, manifest: str) -> DataFrame | None:
    """The manifest of an ingest as one row, None where there is none."""
    return spark.read.json(manifest, multiLine=True) if files.exists(spark, manifest) else None
