import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.operators import chains, evaluation, observations
from ledgerloom.pipeline import Pipeline
from ledgerloom.sources import generator as G
from ledgerloom.sources import truth as T


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    world = G.World(volume=260, days=4, seed=7).run()
    records = world.records()
    third = len(records) // 3
    G.write_json(records[: 2 * third], str(folder / "a.json"))
    G.write_csv(records[third:], str(folder / "b.csv"))
    G.write_xml(records[:third], str(folder / "c.xml"))
    p = Pipeline(spark, str(folder / "store"), trees=20)
    p.ingest([str(folder / n) for n in ("a.json", "b.csv", "c.xml")])
    p.cluster()
    p.graph()
    p.fusion()
    truth = world.truth()
    T.write_truth(truth, str(folder / "truth.json"))
    owned = T.owners(spark, str(folder / "truth.json"))
    owner = owned.select("address", F.col("actor_id").alias("actor"))
    p.detect(T.labels(p.read("entities"), owned), 2)
    return p, truth, owner, records


def test_ingest_counts(run):
    p, truth, _, records = run
    assert p.result.manifest["observations"] == len(records)
    assert p.result.manifest["rejected_records"] == 0
    assert p.result.manifest["transactions"] == len(truth["tx_origin_actor"])
    assert observations.conservation(p.read("tx_l1")).count() == 0


def test_mixing_is_found_exactly(run):
    p, truth, _, _ = run
    assert {r["txid"] for r in p.read("tx_flags").where("is_coinjoin").collect()} == set(truth["coinjoins"])


def test_clusters_and_entities_are_precise(run):
    p, _, owner, _ = run
    r = evaluation.pairwise_scores(p.read("clusters").join(owner, "address"), "group", "actor").first()
    assert r["precision"] >= 0.95
    e = evaluation.pairwise_scores(p.read("entities").join(owner, "address"), "entity_id", "actor").first()
    assert e["precision"] >= 0.90 and e["recall"] >= r["recall"]


def test_planted_hops_are_recovered(run):
    p, truth, _, _ = run
    found = {(r["txid"], r["next_txid"]) for r in chains.consecutive(p.read("chains")).collect()}
    planted = {pair for c in truth["peeling_chains"] for pair in zip(c["txids"], c["txids"][1:])}
    assert len(found & planted) >= 0.7 * len(planted)


def test_leads_name_the_origin(run):
    p, truth, owner, _ = run
    host = {c["actor_id"]: c["origin_ips"][0] for c in truth["clusters"]}
    by = {r["entity_id"]: r["actor"] for r in evaluation.majority(p.read("entities").join(owner, "address"), "entity_id", "actor").collect()}
    leads = p.read("leads").where("significant").collect()
    assert len(leads) >= 5
    assert sum(host[by[r["entity_id"]]] == r["ip"] for r in leads) >= 0.85 * len(leads)


def test_scores_and_alerts(run):
    p, *_ = run
    assert p.done == ["ingest", "cluster", "graph", "fusion", "detect"]
    scores = p.read("scores")
    assert scores.count() == p.read("features").count() > 10
    assert scores.where("risk_score not between 0 and 1 or anomaly_score not between 0 and 1").count() == 0
    alerts = p.store().alerts().collect()
    assert [r["risk_score"] for r in alerts] == sorted((r["risk_score"] for r in alerts), reverse=True)
    assert len(alerts) == scores.count()
    assert p.store().summary().first()["transactions"] == p.read("tx_l1").count()
    assert p.store().pipeline_stats().count() == 5


def test_truth_is_read(spark, run):
    p, truth, _, _ = run
    path = p.out.replace("store", "truth.json")
    assert {r["txid"]: r["actor_id"] for r in T.origins(spark, path).collect()} == truth["tx_origin_actor"]


def test_edges_have_nodes(run):
    from ledgerloom.operators.graph import dangling_edges

    p, *_ = run
    assert dangling_edges(p.read("graph_nodes"), p.read("graph_edges")).count() == 0


@pytest.fixture(scope="module")
def as_tables(run, tmp_path_factory):
    """The store in the shape of the test tables."""
    p, *_ = run
    folder = str(tmp_path_factory.mktemp("tables"))
    day = F.lit("2027-01-05 00:00:00").cast("timestamp_ntz")
    for name in ("tx_l1", "net_l2", "clusters", "entities", "leads", "scores", "graph_nodes", "graph_edges"):
        df = p.read(name)
        df = df.withColumns({"loaded_at": day, "retired_at": F.lit(None).cast("timestamp_ntz")}) if name not in ("tx_l1", "net_l2", "clusters") else df
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


#: Queries whose SQL is run over generated data, with the flags that must occur with both values; elsewhere all results have rows.
OVER_GENERATED = {
    "coinjoin_flags": ["is_coinjoin"], "coinjoins": [], "change_guesses": ["change_corroborated"], "peel_chains": ["laundering_like"], "chain_steps": [], "chain_list": [], "chain_hops": [], "best_leads": [],
    "budgeted_clusters": [], "folded_entities": [], "alerts": ["laundering_like"], "summary_totals": [], "pipeline_stats": [], "entity_features": [], "attributed_hosts": [],
}


@pytest.mark.parametrize("name", OVER_GENERATED)
def test_sql_over_generated_data(spark, as_tables, name):
    from tests.test_oracle import norm

    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, as_tables)
    got = df.collect()
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(as_tables):
        con.sql(f"create view {f.removesuffix('.parquet')} as from read_parquet('{as_tables}/{f}/*.parquet')")
    columns = sorted(df.columns)
    wanted = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(norm(r[c]) for c in columns) for r in got), key=str) == sorted((tuple(map(norm, r)) for r in wanted), key=str)
    assert got
    for flag in OVER_GENERATED[name]:
        assert {True, False} <= {r[flag] for r in got}


def test_stages_stop_at_the_first_failure(spark):
    from ledgerloom.pipeline import run_stages

    ran = []
    outcomes = run_stages(spark, [("one", lambda: ran.append(1)), ("two", lambda: 1 / 0), ("three", lambda: ran.append(3))])
    assert ran == [1]
    assert [(o.stage, o.ok) for o in outcomes] == [("one", True), ("two", False)]
    assert "ZeroDivisionError" in outcomes[1].error and all(o.seconds >= 0 for o in outcomes)


def test_a_stage_that_takes_too_long_is_given_up(spark):
    from pyspark.sql.types import LongType

    from ledgerloom.pipeline import run_stages

    @F.udf(LongType())
    def slow(x):
        import time

        time.sleep(60)
        return x

    [outcome] = run_stages(spark, [("slow", lambda: spark.range(2).select(slow("id")).collect())], timeout=1.5)
    assert not outcome.ok and outcome.error.startswith("timed out") and outcome.seconds < 30


def test_run_from_evidence_to_leads(spark, tmp_path):
    from ledgerloom.serve import custody

    world = G.World(volume=40, days=2, seed=3).run()
    G.write_json(world.records(), str(tmp_path / "a.json"))
    p = Pipeline(spark, str(tmp_path / "store"))
    outcomes = p.run([str(tmp_path / "a.json")])
    assert [(o.stage, o.ok, o.error) for o in outcomes] == [(s, True, "") for s in ("ingest", "cluster", "graph", "fusion")]
    kept = custody(spark, str(tmp_path / "store" / "manifest.json")).first()
    assert kept["transactions"] == len(world.txs) and kept["sources"][0]["bytes"] == (tmp_path / "a.json").stat().st_size
    assert custody(spark, str(tmp_path / "none.json")) is None
    assert Pipeline(spark, str(tmp_path / "other")).run([str(tmp_path / "missing.json")])[-1].stage == "ingest"
