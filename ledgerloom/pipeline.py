"""All stages in order, from evidence to scores, each written to the store before the next reads it.

    python -m ledgerloom.pipeline STORE EVIDENCE... [--databases FOLDER] [--truth FILE]
"""

from __future__ import annotations

import argparse
import threading
import time
import traceback
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .operators import attribution, chains, change, cospend, entities, features, forest, graph
from .serve import Store
from .sources.ingest import ingest, write_table


#: Seconds after which a stage is given up.
TIMEOUT = 900.0


@dataclass
class Outcome:
    """How a stage ended: its name, whether it succeeded, the seconds it took and the end of what went wrong."""

    stage: str
    ok: bool
    seconds: float
    error: str = ""


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[], object]]], timeout: float = TIMEOUT) -> list[Outcome]:
    """Run stages one after the other and stop at the first that fails; one that takes longer than ``timeout`` has its jobs cancelled."""
    outcomes = []
    for name, stage in stages:
        began, late, tag = time.monotonic(), threading.Event(), f"stage-{uuid.uuid4().hex}"

        def give_up(late: threading.Event = late, tag: str = tag) -> None:
            late.set()
            while not over.wait(0.5):  # jobs that start later are cancelled as well
                spark.sparkContext.cancelJobsWithTag(tag)

        over, clock = threading.Event(), threading.Timer(timeout, give_up)
        clock.daemon = True
        spark.sparkContext.addJobTag(tag)
        clock.start()
        try:
            stage()
            error = f"timed out after {timeout:g} s" if late.is_set() else ""
        except Exception:
            error = f"timed out after {timeout:g} s" if late.is_set() else traceback.format_exc()[-4000:]
        finally:
            over.set()
            clock.cancel()
            spark.sparkContext.removeJobTag(tag)
        outcomes.append(Outcome(name, not error, time.monotonic() - began, error))
        if error:
            break
    return outcomes


@dataclass
class Pipeline:
    """The store in folder ``out``.  Options: no mixing filter, no change merges, least chain length and transactions."""

    spark: SparkSession
    out: str
    mixing_filter: bool = True
    use_change: bool = True
    min_chain: int = K.MIN_CHAIN_LENGTH
    min_transactions: int = K.MIN_TRANSACTIONS
    trees: int = K.FOREST_TREES
    done: list[str] = field(default_factory=list)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}.parquet")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        write_table(df, f"{self.out}/{name}.parquet")
        return self.read(name)

    def ingest(self, paths: list[str], geo_ranges: DataFrame | None = None) -> None:
        self.result = ingest(self.spark, paths, self.out, geo_ranges, f"{self.out}/manifest.json")
        self.done.append("ingest")

    def cluster(self) -> None:
        tx = self.read("tx_l1")
        flags = self._write(change.transaction_flags(tx), "tx_flags")
        if not self.mixing_filter:
            flags = flags.withColumn("is_coinjoin", F.lit(False))
        groups = self._write(cospend.cospend_groups(tx, flags), "cospend")
        if self.use_change:
            groups = cospend.budgeted_merge(tx, flags, groups)
        self._write(cospend.cluster_table(groups), "clusters")
        self.done.append("cluster")

    def graph(self) -> None:
        tx, l2 = self.read("tx_l1"), self.read("net_l2")
        found = self._write(chains.detect(tx, self.min_chain), "chain_hops")
        folded = entities.fold(self.read("clusters").select("address", "group"), found)
        owners = self._write(folded.select("address", F.concat(F.lit("E-"), "entity").alias("entity_id"), F.concat(F.lit("C-"), "group").alias("cluster_id")), "entities")
        self._write(chains.with_entities(found, owners), "chains")
        nodes, edges = graph.build(tx, l2, owners)
        self._write(nodes, "graph_nodes")
        self._write(edges, "graph_edges")
        self.done.append("graph")

    @cached_property
    def sightings(self) -> DataFrame:
        return self.read("net_l2").select("txid", "src_ip", "arrival_rank", "asn", F.col("geo_country").alias("country"))

    def fusion(self) -> None:
        of = graph.tx_entity(self.read("tx_l1"), self.read("entities"))
        best = attribution.best_per_entity(attribution.leads(self.sightings, of, self.min_transactions))
        geo = attribution.geo_concentration(self.sightings, of).drop("top_country_share")
        self._write(best.join(geo, "entity_id", "left"), "leads")
        self.done.append("fusion")

    def detect(self, labels: DataFrame, min_transactions: int = K.SCORING_MIN_TRANSACTIONS) -> None:
        """``labels``: entity_id and label (0 or 1)."""
        heads = self.read("chains").where("hop = 0")
        rows = features.extract(self.read("tx_l1"), self.read("entities"), self.read("tx_flags"), heads, self.read("leads"), min_transactions)
        rows = self._write(rows.join(labels, "entity_id", "left"), "features")
        self._write(forest.score_table(rows, self.trees), "scores")
        self.done.append("detect")

    def store(self) -> Store:
        return Store(self.read("tx_l1"), self.read("net_l2"), self.read("entities"), self.read("chains"), self.read("tx_flags"), self.read("leads"), self.read("scores"), self.read("graph_nodes"), self.read("graph_edges"))

    def run(self, paths: list[str], geo_ranges: DataFrame | None = None, labels: Callable[[DataFrame], DataFrame] | None = None, timeout: float = TIMEOUT) -> list[Outcome]:
        """All stages; ``labels`` makes (entity_id, label) of the entities, without it the models are left out."""
        stages = [("ingest", lambda: self.ingest(paths, geo_ranges)), ("cluster", self.cluster), ("graph", self.graph), ("fusion", self.fusion)]
        if labels is not None:
            stages.append(("detect", lambda: self.detect(labels(self.read("entities")))))
        return run_stages(self.spark, stages, timeout)


def main(arguments: list[str] | None = None) -> int:
    from .session import get_session
    from .sources import mmdb, truth

    parser = argparse.ArgumentParser(description="Evidence to scored entities, stage by stage.")
    parser.add_argument("store")
    parser.add_argument("evidence", nargs="+")
    parser.add_argument("--databases", help="folder of .mmdb files")
    parser.add_argument("--truth", help="truth file with labels for the models")
    parser.add_argument("--timeout", type=float, default=TIMEOUT)
    asked = parser.parse_args(arguments)
    spark = get_session("pipeline")
    ranges = mmdb.read_folder(spark, asked.databases) if asked.databases else None
    labels = (lambda entities: truth.labels(entities, truth.owners(spark, asked.truth))) if asked.truth else None
    outcomes = Pipeline(spark, asked.store).run(asked.evidence, ranges, labels, asked.timeout)
    for o in outcomes:
        print(f"{o.stage:8} {'done' if o.ok else 'failed'} {o.seconds:8.1f} s {o.error}")
    return 0 if all(o.ok for o in outcomes) else 1


if __name__ == "__main__":
    raise SystemExit(main())
