"""Synthetic evidence with its truth: actors that pay, consolidate, mix and peel, seen by sensors with delays.

A driver-side fixture for tests and demonstrations, deterministic by its seed; not a data-parallel operator.
"""

from __future__ import annotations

import csv
import hashlib
import json
import random
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from .evidence import FIELDS, LISTS, SEPARATOR

# Kinds of actors and how many there are of each, and which are illicit
KINDS = {"retail": 40, "merchant": 10, "exchange": 4, "miner": 4, "mixer": 2, "ransomware": 4, "darknet_market": 4, "extortion": 3, "launderer": 3}
ILLICIT = {"ransomware", "darknet_market", "extortion", "launderer"}
COVERAGE = 0.70
START_MICROS = 1_785_542_400_000_000
SATS = 100_000_000


@dataclass
class Actor:
    name: str
    kind: str
    host: str
    country: str
    asn: int
    script: str
    addresses: list[str] = field(default_factory=list)
    coins: list[tuple[str, int]] = field(default_factory=list)

    @property
    def illicit(self) -> bool:
        return self.kind in ILLICIT


@dataclass
class Tx:
    txid: str
    at: int
    inputs: list[tuple[str, int]]
    outputs: list[tuple[str, int]]
    fee: int
    script: str
    actor: str
    change: str | None = None
    mixes: bool = False


class World:
    """The ledger as it grows: actors, their unspent coins and the transactions so far."""

    def __init__(self, volume: int = 400, days: int = 5, seed: int = 42) -> None:
        self.rng = random.Random(seed)
        self.days, self.volume, self.n = days, volume, 0
        self.txs: list[Tx] = []
        self.chains: list[list[str]] = []
        self.actors = [self._actor(kind, i) for kind, count in KINDS.items() for i in range(count)]
        self.relays = [f"198.51.100.{i}" for i in range(1, 60)]

    def _actor(self, kind: str, i: int) -> Actor:
        self.n += 1
        script = self.rng.choice(["v0_p2wpkh", "p2sh", "p2pkh"])
        actor = Actor(f"{kind}-{i}", kind, f"203.0.113.{self.n}", self.rng.choice(["DE", "IN", "US", "BR", "JP"]), 64512 + self.rng.randrange(40), script)
        for _ in range(4):
            actor.coins.append((self.fresh(actor), self.rng.randrange(2 * SATS, 40 * SATS)))
        return actor

    def fresh(self, actor: Actor) -> str:
        """A new address of the actor."""
        self.n += 1
        body = hashlib.sha256(f"{actor.name}/{self.n}/{self.rng.random()}".encode()).hexdigest()[:30]
        address = {"v0_p2wpkh": "bc1q", "p2sh": "3", "p2pkh": "1"}[actor.script] + body
        actor.addresses.append(address)
        return address

    def when(self) -> int:
        return START_MICROS + self.rng.randrange(self.days * 86_400_000_000)

    def _book(self, at: int, actor: Actor, inputs: list, outputs: list[tuple[str, int]], owners: list[Actor], change: str | None = None, mixes: bool = False) -> Tx:
        fee = sum(a for _, a in inputs) - sum(a for _, a in outputs)
        txid = hashlib.sha256(f"{len(self.txs)}/{at}/{outputs}".encode()).hexdigest()
        tx = Tx(txid, at, inputs, outputs, fee, actor.script, actor.name, change, mixes)
        for coin, owner in zip(outputs, owners):
            owner.coins.append(coin)
        self.txs.append(tx)
        return tx

    def pay(self, at: int, payer: Actor, payee: Actor, round_amount: bool = True) -> Tx | None:
        """A payment of the largest coins first, the rest back to a fresh address."""
        coins = sorted(payer.coins, key=lambda c: -c[1])[: self.rng.choice([1, 1, 2, 3])]
        total = sum(a for _, a in coins)
        if total < SATS // 50:
            return None
        amount = int(total * self.rng.uniform(0.2, 0.6))
        amount = max(100_000, amount // 100_000 * 100_000) if round_amount else amount
        fee = self.rng.randrange(500, 9_000)
        for c in coins:
            payer.coins.remove(c)
        change = self.fresh(payer)
        outputs, owners = [(self.fresh(payee), amount), (change, total - amount - fee)], [payee, payer]
        if self.rng.random() < 0.5:
            outputs, owners = outputs[::-1], owners[::-1]
        return self._book(at, payer, coins, outputs, owners, change)

    def consolidate(self, at: int, actor: Actor) -> Tx | None:
        coins = actor.coins[:5]
        if len(coins) < 2:
            return None
        del actor.coins[: len(coins)]
        return self._book(at, actor, coins, [(self.fresh(actor), sum(a for _, a in coins) - 2_000)], [actor])

    def mix(self, at: int) -> Tx | None:
        """Several actors put in a coin each and take out one equal amount and their remainder."""
        ready = [a for a in self.actors if any(c[1] > SATS for c in a.coins)]
        if len(ready) < 4:
            return None
        joined = self.rng.sample(ready, 4)
        coins = [max(a.coins, key=lambda c: c[1]) for a in joined]
        equal = min(c[1] for c in coins) // 2
        outputs, owners = [], []
        for a, c in zip(joined, coins):
            a.coins.remove(c)
            outputs += [(self.fresh(a), equal), (self.fresh(a), c[1] - equal - 1_000)]
            owners += [a, a]
        return self._book(at, joined[0], coins, outputs, owners, mixes=True)

    def peel(self, at: int, actor: Actor, hops: int) -> list[str]:
        """A chain: a balance handed on with a small slice cut off at each hop."""
        coin = (self.fresh(actor), self.rng.randrange(80 * SATS, 200 * SATS))
        out = []
        for _ in range(hops):
            slice_ = int(coin[1] * self.rng.uniform(0.02, 0.05))
            onward, payee = (self.fresh(actor), coin[1] - slice_ - 1_500), self.rng.choice(self.actors)
            tx = self._book(at, actor, [coin], [(self.fresh(payee), slice_), onward], [payee, actor], onward[0])
            actor.coins.remove(onward)
            coin, at = onward, at + self.rng.randrange(60_000_000, 3_600_000_000)
            out.append(tx.txid)
        actor.coins.append(coin)
        return out

    def run(self) -> World:
        times = sorted(self.when() for _ in range(self.volume))
        for i, at in enumerate(times):
            actor = self.rng.choice(self.actors)
            kind = self.rng.random()
            if kind < 0.78:
                self.pay(at, actor, self.rng.choice(self.actors), self.rng.random() < 0.8)
            elif kind < 0.95:
                self.consolidate(at, actor)
            else:
                self.mix(at)
            if i % max(1, self.volume // 8) == 0:
                self.chains.append(self.peel(at, self.rng.choice([a for a in self.actors if a.illicit]), self.rng.randrange(8, 14)))
        self.txs.sort(key=lambda t: (t.at, t.txid))
        return self

    def records(self) -> list[dict]:
        """A record per sighting; the origin is the first relay where a sensor covers it."""
        by_name = {a.name: a for a in self.actors}
        out = []
        for tx in self.txs:
            actor = by_name[tx.actor]
            hosts = [(actor.host, self.rng.lognormvariate(-0.1, 0.45))] if self.rng.random() < COVERAGE else []
            hosts += [(h, self.rng.lognormvariate(2.6, 0.7)) for h in self.rng.sample(self.relays, self.rng.randrange(2, 6))]
            for host, ms in sorted(hosts, key=lambda h: h[1]):
                out.append(self._record(tx, actor, host, tx.at + int(ms * 1000)))
        return out

    def _record(self, tx: Tx, actor: Actor, host: str, at: int) -> dict:
        from datetime import datetime, timedelta

        seen = datetime(1970, 1, 1) + timedelta(microseconds=at)
        btc = lambda sats: f"{sats // SATS}.{sats % SATS:08d}"
        own = host == actor.host
        return dict(
            zip(
                FIELDS,
                [seen.isoformat(timespec="microseconds") + "Z", host, 41000, "192.0.2.9", 8333, tx.txid, [a for a, _ in tx.inputs], [a for a, _ in tx.outputs], [btc(s) for _, s in tx.inputs], [btc(s) for _, s in tx.outputs], btc(tx.fee), tx.script, actor.country if own else "ZZ", actor.asn if own else 64500],
            )
        )

    def truth(self) -> dict:
        """Who owns which addresses, who sent which transaction, and the chains and mixes there are."""
        return {
            "clusters": [{"actor_id": a.name, "kind": a.kind, "illicit": a.illicit, "origin_ips": [a.host], "addresses": a.addresses} for a in self.actors],
            "tx_origin_actor": {t.txid: t.actor for t in self.txs},
            "change_addresses": {t.txid: t.change for t in self.txs if t.change},
            "peeling_chains": [{"txids": c} for c in self.chains],
            "coinjoins": [t.txid for t in self.txs if t.mixes],
        }


def write_json(records: list[dict], path: str) -> None:
    with open(path, "w") as f:
        json.dump(records, f)


def write_csv(records: list[dict], path: str) -> None:
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(FIELDS)
        w.writerows([[SEPARATOR.join(r[n]) if n in LISTS else r[n] for n in FIELDS] for r in records])


def write_xml(records: list[dict], path: str) -> None:
    with open(path, "w") as f:
        f.write("<observations>\n")
        for r in records:
            cells = "".join(f"<{n}>{''.join(f'<item>{escape(x)}</item>' for x in r[n]) if n in LISTS else escape(str(r[n]))}</{n}>" for n in FIELDS)
            f.write(f"<observation>{cells}</observation>\n")
        f.write("</observations>\n")
