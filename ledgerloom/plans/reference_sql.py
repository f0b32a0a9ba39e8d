"""SQL of the ledger and network queries, for the engine the results are compared with."""

from __future__ import annotations

from types import SimpleNamespace

from .. import constants as K
from .problems import _address, _id
from .reference import LOW, RANGES


def _with(*names: str, recursive: bool = False, low: bool = False) -> str:
    """The common tables ``names`` with all they build on, with low thresholds or the fixed ones."""
    tables = _LOW_TABLES if low else _TABLES
    need: list[str] = []

    def add(name: str) -> None:
        for other in _USES.get(name, []):
            add(other)
        if name not in need:
            need.append(name)

    for n in names:
        add(n)
    head = "with recursive " if recursive or any(n in _RECURSIVE for n in need) else "with "
    return head + ",\n".join(f"{_NAME.get(n, n)} as ({tables[n]})" for n in need) + "\n"


_BAND = "case " + " ".join(f"when risk_score >= {least} then '{name}'" for least, name in K.RISK_BANDS) + f" else '{K.LOWEST_BAND}' end"
_ORDER = "src_ip, src_port, dst_ip, dst_port, asn, geo_country, arrival_rank"
_REST = "src_port, dst_ip, dst_port, geo_country, asn, asn_org, country_source, asn_source, arrival_rank"


def _nulls_last(columns: str) -> str:
    return ", ".join(f"{c.strip()} nulls last" for c in columns.split(","))


def _latest(t: str) -> str:
    return f"""select * exclude (entity_id, _n, k), k as entity_id from (select *, row_number() over (partition by k order by loaded_at desc nulls last) as _n
      from (select *, {_id('entity_id')} as k from {t}) where k is not null) where _n = 1"""


#: Sums of the weights 0.30 fresh, 0.40 ragged, 0.15 script and 0.35 soon, by the bits of what holds, as doubles add up.
_SUMS = (
    "[0.0::double, 0.3::double, 0.4::double, 0.7::double, 0.15::double, 0.44999999999999996::double, 0.55::double, 0.85::double, "
    "0.35::double, 0.6499999999999999::double, 0.75::double, 1.05::double, 0.5::double, 0.7999999999999999::double, 0.9::double, 1.2::double]"
)


def _tables(K) -> dict[str, str]:
    """The common tables under the thresholds ``K``."""
    return {
        "tx": "select distinct * from tx_l1 where txid is not null",
        "l2": "select distinct * from net_l2",
        "sight": f"select distinct txid, {_id('src_ip')} as src_ip, arrival_rank, asn, geo_country as country from net_l2",
        "owners": f"select {_address('address')} as address, min({_id('entity_id')}) as entity_id from entities where {_address('address')} is not null and {_id('entity_id')} is not null group by 1",
        "owned": f"select {_address('address')} as address, min({_id('entity_id')}) as entity_id, min({_id('cluster_id')}) as cluster_id from entities where {_address('address')} is not null and {_id('entity_id')} is not null group by 1",
        "txent": f"select txid, entity_id from tx join owners on owners.address = {_address('tx.input_addresses[1]')}",
        "scored": _latest("scores"),
        "led": _latest("leads"),
        "nodes1": "select * exclude _n from (select *, row_number() over (partition by id order by loaded_at nulls last, label, name nulls last, weight nulls last) as _n from graph_nodes) where _n = 1",
        "mix0": "select txid, len(input_addresses) as n_in, len(output_amounts) as n_out, output_amounts as a from tx",
        "mix1": "select txid, n_in, n_out, list_aggregate(list_transform(list_distinct(a), lambda v: struct_pack(n := len(list_filter(a, lambda x: x = v)), place := -list_position(a, v), value := v)), 'max') as top from mix0",
        "flags": f"""select txid, n_in >= {K.MIN_INPUTS} and n_out >= {K.MIN_OUTPUTS} and top.n >= {K.MIN_EQUAL_OUTPUTS} as is_coinjoin,
          case when n_in < {K.MIN_INPUTS} or n_out < {K.MIN_OUTPUTS} then 0 else top.n end as equal_count,
          case when n_in >= {K.MIN_INPUTS} and n_out >= {K.MIN_OUTPUTS} and top.n >= {K.MIN_EQUAL_OUTPUTS} then top.value end as denomination,
          case when n_in < {K.MIN_INPUTS} or n_out < {K.MIN_OUTPUTS} then printf('%d inputs, %d outputs: too small', n_in, n_out)
            when top.n < {K.MIN_EQUAL_OUTPUTS} then printf('largest equal-value group is %d, need {K.MIN_EQUAL_OUTPUTS}', top.n)
            else printf('%d outputs of %.8f BTC across %d inputs', top.n, top.value / 1e8, n_in) end as coinjoin_reason from mix1""",
        "uses": "select unnest(input_addresses) as address, txid, ts_micro, true as spends from tx where ts_micro is not null union all select unnest(output_addresses), txid, ts_micro, false from tx where ts_micro is not null",
        "seen": "select address, min(struct_pack(t := ts_micro, x := txid)) as seen, min(ts_micro) filter (spends) as spent_at from uses group by 1",
        "outs2": "select txid, ts_micro, script_type, unnest([0, 1]) as place, unnest(output_addresses) as address, unnest(output_amounts) as amount from tx where len(output_addresses) = 2 and ts_micro is not null",
        "scored2": f"""select o.txid, place, o.address, amount % {K.ROUND_UNIT} <> 0 as ragged, {_SUMS}[1
            + if(seen.t = ts_micro and seen.x = o.txid, 1, 0) + if(amount % 100000 <> 0, 2, 0)
            + if(coalesce((case {' '.join(f"when starts_with(o.address, '{p}') then '{s}'" for p, s in K.SCRIPT_PREFIXES)} else '{K.UNKNOWN_SCRIPT}' end) = script_type, false), 4, 0)
            + if(coalesce(spent_at - ts_micro between 0 and {K.SPENT_SOON_MICROS}, false), 8, 0)] as score
          from outs2 o join seen on seen.address = o.address""",
        "pair2": "select a.txid, abs(a.score - b.score) as margin, if(a.score >= b.score, 0, 1) as best, a.address as a0, b.address as a1, a.ragged as r0, b.ragged as r1 from scored2 a join scored2 b on a.txid = b.txid and a.place = 0 and b.place = 1",
        "guess": f"""select tx.txid, case when margin >= {K.MIN_MARGIN} then best end::bigint as change_index, case when margin >= {K.MIN_MARGIN} then if(best = 0, a0, a1) end as change_address,
          coalesce(margin, 0.0)::double as change_confidence, coalesce(if(best = 0, r0, r1), false) as change_corroborated from tx left join pair2 using (txid)""",
        "vertices": "select distinct address from (select unnest(input_addresses) as address from tx union all select unnest(output_addresses) from tx)",
        "links": "select distinct input_addresses[1] as x, unnest(input_addresses) as y from tx join flags using (txid) where not is_coinjoin",
        "tied": "select x, y from links union select y, x from links union select address, address from vertices",
        "cosp": "select x, y from tied union select cosp.x, tied.y from cosp join tied on cosp.y = tied.x",
        "groups": 'select x as address, min(y) as "group" from cosp group by 1',
        "peel": "select txid, ts_micro, output_addresses as oa, output_amounts as am, list_sum(output_amounts) as total from tx where n_inputs = 1 and n_outputs = 2",
        "spender": "select address, min(struct_pack(t := ts_micro, x := txid)).x as next_txid from uses where spends group by 1",
        "peelout": "select txid, total, unnest(oa) as address, unnest(am) as amount from peel",
        "best": "select o.txid, o.total, max(struct_pack(m := amount, a := o.address, n := next_txid)) as b from peelout o join spender using (address) where next_txid in (select txid from peel) group by 1, 2",
        "succ": f"select txid, b.a as carried_address, b.n as next_txid from best where total > 0 and b.m / total >= {K.MIN_CARRY_SHARE}",
        "walk": """select txid as start, 0 as hop, txid, [txid] as path from succ where txid not in (select next_txid from succ)
          union all select start, hop + 1, next_txid, list_append(path, next_txid) from walk join succ using (txid) where not list_contains(path, next_txid)""",
        "hopcount": f"select start, count(*) as hops from walk group by 1 having count(*) >= {K.MIN_CHAIN_LENGTH}",
        "hopped": "select w.start, w.hop, w.txid, h.hops, list_sum(t.output_amounts) as total, list_min(t.output_amounts) as peel, s.carried_address from walk w join hopcount h using (start) join tx t using (txid) left join succ s using (txid)",
        "priced": "select start, sum(peel) as peeled, list_sort(list(peel / total) filter (total > 0)) as shares from hopped group by 1",
        "chain0": f"""select 'CH-' || h.start[1:10] as chain_id, h.start, h.hop::bigint as hop, h.txid, case when h.hop < h.hops - 1 then h.carried_address end as carried_address, h.hops,
          p.peeled::bigint as peeled_sats, coalesce(shares[len(shares) // 2 + 1], 0.0) as median_peel, case when len(shares) < 2 then 1.0 else list_max(shares) - list_min(shares) end as peel_spread
          from hopped h join priced p using (start)""",
        "chain1": f"select *, hops >= {K.LAUNDERING_MIN_HOPS} and median_peel <= {K.LAUNDERING_MAX_MEDIAN_PEEL} and peel_spread <= {K.LAUNDERING_MAX_SPREAD} as laundering_like from chain0",
        "chain": "select c.*, e.entity_id from chain1 c left join (select start, carried_address from chain1 where hop = 0) f using (start) left join owners e on e.address = f.carried_address",
        "heads": "select * from chain where hop = 0",
        "flow": """select source, target, sum(amount)::bigint as amount, count(*) as observations from (select e.entity_id as source, unnest(output_addresses) as address, unnest(output_amounts) as amount from tx join txent e using (txid)) f
          join (select address, entity_id as target from owners) o using (address) where source <> target group by 1, 2""",
        "seenfrom": "select entity_id, src_ip, min(asn) as asn, min(country) as geo_country, count(*) as n from sight join txent using (txid) where arrival_rank = 1 and src_ip is not null group by 1, 2",
        "hosts": """select src_ip, b.n as n, 'AS' || coalesce(b.a::varchar, '') as network, b.c as country from (select src_ip, arg_max(struct_pack(n := n, a := asn, c := geo_country), struct_pack(n := n, e := entity_id)) as b from seenfrom group by 1)""",
        "attrhosts": "select src_ip, count(*) filter (arrival_rank = 1) as firsts, arg_min(struct_pack(asn := asn, country := country), struct_pack(t := txid, r := arrival_rank, a := coalesce(asn, -1), c := coalesce(country, ''))) as meta from sight where src_ip is not null group by 1",
        "met": "select entity_id, txid, src_ip, arrival_rank from sight join txent using (txid) where src_ip is not null and arrival_rank is not null",
        "pairs": "select entity_id, src_ip, sum(1.0::double / arrival_rank) as rank_weight, count(*) filter (arrival_rank = 1) as hits, min(struct_pack(t := txid, r := arrival_rank)) as first_at from met group by 1, 2",
        "sizes": "select entity_id, count(distinct txid) as transactions from met group by 1",
        "tested": f"select p.entity_id, p.src_ip as ip, hits, transactions, rank_weight, firsts / (select count(*) from sight where src_ip is not null and arrival_rank = 1) as baseline, meta, first_at from pairs p join sizes using (entity_id) join attrhosts using (src_ip) where hits > 0 and transactions >= {K.MIN_TRANSACTIONS} and firsts > 0",
        "lead0": """select *, case when baseline >= 1 then 1.0 else list_sum(list_transform(range(hits, transactions + 1),
          lambda i: exp(lgamma(transactions + 1) - lgamma(i + 1) - lgamma(transactions - i + 1) + i * ln(baseline) + (transactions - i) * ln(1 - baseline)))) end as p0 from tested""",
        "lead": f"""select *, least(1.0, p0) as p, least(1.0, least(1.0, p0) * (select count(*) from tested)) as adj, least(1.0, least(1.0, p0) * (select count(*) from tested)) <= {K.SIGNIFICANCE} as significant from lead0""",
        "geo": "select entity_id, country, asn from sight join txent using (txid) where arrival_rank = 1",
        "calls": f"""select t.ts_micro, t.txid, ga."group" as a, gb."group" as b, change_confidence as conf, row_number() over (order by t.ts_micro nulls last, t.txid) as turn
          from tx t join flags using (txid) join guess using (txid) join groups ga on ga.address = t.input_addresses[1] join groups gb on gb.address = change_address
          where not is_coinjoin and change_corroborated and change_confidence >= {K.MIN_MERGE_CONFIDENCE} and ga."group" <> gb."group\"""",
        "ends": """select name, row_number() over (order by name) as i, (select count(*) from groups where "group" = name) as n from (select a as name from calls union select b from calls)""",
        "coded": "select turn, x.i as i, y.i as j, conf from calls join ends x on x.name = a join ends y on y.name = b",
        # the calls one after the other: of each group its representative, of each representative its size
        "replay": f"""select 0 as turn, (select list(i order by i) from ends) as own, (select list(n order by i) from ends) as size
          union all select turn + 1, if(fits, list_transform(own, lambda x: if(x = hi, lo, x)), own), if(fits, list_transform(size, lambda x, k: if(k = lo, x + size[hi], x)), size)
          from (select r.turn, own, size, least(own[c.i], own[c.j]) as lo, greatest(own[c.i], own[c.j]) as hi, own[c.i] <> own[c.j] and (size[own[c.i]] * size[own[c.j]] <= {K.MERGE_BUDGET} or conf >= {K.MERGE_ANYWAY_CONFIDENCE}) as fits
            from replay r join coded c on c.turn = r.turn + 1)""",
        "merged": "select e.name, f.name as into_name from ends e, (select own from replay order by turn desc limit 1) r join ends f on f.i = r.own[e.i]",
        "carried": """select distinct start, "group" from chain0 join groups on address = carried_address""",
        "foldlinks": """select distinct a."group" as x, b."group" as y from carried a join carried b using (start)""",
        "folds": "select x, y from foldlinks union select folds.x, foldlinks.y from folds join foldlinks on folds.y = foldlinks.x",
        "folded": """select address, coalesce(f.entity, "group") as entity, "group" from groups left join (select x, min(y) as entity from folds group by 1) f on f.x = "group\"""",
    }


_TABLES = _tables(K)
_LOW_TABLES = _tables(SimpleNamespace(**{**vars(K), **LOW}))
_NAME: dict[str, str] = {}
_USES = {
    "txent": ["tx", "owners"], "mix0": ["tx"], "mix1": ["mix0"], "flags": ["mix1"], "uses": ["tx"], "seen": ["uses"], "outs2": ["tx"], "scored2": ["outs2", "seen"], "pair2": ["scored2"], "guess": ["tx", "pair2"],
    "vertices": ["tx"], "links": ["tx", "flags"], "tied": ["links", "vertices"], "cosp": ["tied"], "groups": ["cosp"],
    "peel": ["tx"], "spender": ["uses"], "peelout": ["peel"], "best": ["peelout", "spender"], "succ": ["best"], "walk": ["succ"], "hopcount": ["walk"], "hopped": ["hopcount"], "priced": ["hopped"], "chain0": ["priced"], "chain1": ["chain0"], "chain": ["chain1", "owners"], "heads": ["chain"],
    "flow": ["txent"], "seenfrom": ["sight", "txent"], "hosts": ["seenfrom"], "attrhosts": ["sight"], "met": ["sight", "txent"], "pairs": ["met"], "sizes": ["met"], "tested": ["pairs", "sizes", "attrhosts"], "lead0": ["tested"], "lead": ["lead0"], "geo": ["sight", "txent"],
    "calls": ["flags", "guess", "groups"], "ends": ["calls"], "coded": ["ends"], "replay": ["coded"], "merged": ["replay"], "carried": ["chain0", "groups"], "foldlinks": ["carried"], "folds": ["foldlinks"], "folded": ["folds"],
}
_RECURSIVE = {"cosp", "walk", "replay", "folds"}

_RANKED = f"row_number() over (partition by txid order by ts_micro nulls last, {_nulls_last(_ORDER)})"
_BUSIEST = "(select entity_id from owned group by 1 order by count(*) desc, entity_id limit 1)"
_FOCUS = f"(select {_id('source')} as id from graph_edges where label = 'SENT_TO' and {_id('source')} is not null group by 1 order by count(*) desc, id limit 1)"
_WAYS = f"select {_id('source')} as a, {_id('target')} as b from graph_edges union select {_id('target')}, {_id('source')} from graph_edges"
_LED_SCORES = "led l join (select entity_id, risk_score from scored) s using (entity_id)"
_HIGH = K.RISK_BANDS[1][0]

_ALERTS = """select s.entity_id, s.risk_score, s.is_anomaly, s.factors, l.ip, l.country, l.asn, l.hits, l.transactions, l.confidence as attribution_confidence, l.significant as attribution_significant, l.n_countries,
      coalesce(c.hops, 0) as chain_hops, coalesce(c.ll, false) as laundering_like, o.n as n_addresses
      from scored s left join led l using (entity_id) left join (select entity_id, max(hops) as hops, bool_or(laundering_like) as ll from heads group by 1) c using (entity_id) left join (select entity_id, count(*) as n from owned group by 1) o using (entity_id)"""

_FEATURE_SQL = (
    _with("tx", "owners", "flags", "heads")
    + f""", spend as (select o.entity_id, tx.* from tx join owners o on o.address = tx.input_addresses[1]),
base as (select entity_id, count(*) as n_transactions, count(distinct date_trunc('day', make_timestamp(ts_micro))) as days, sum(total_out) as total_out, avg(total_out) as mean_value, median(total_out) as median_value,
  stddev_pop(total_out) as value_spread, avg(fee) as mean_fee, stddev_pop(fee) as fee_spread, avg(n_inputs) as mean_inputs, avg(n_outputs) as mean_outputs, max(n_inputs) as max_inputs, count(distinct script_type) as n_script_types,
  avg(hour(make_timestamp(ts_micro))) as mean_hour, count(*) filter (hour(make_timestamp(ts_micro)) < 6) / count(*) as nocturnal_share, count(distinct hour(make_timestamp(ts_micro))) / 24.0 as hour_coverage
  from spend group by 1 having count(*) >= {K.SCORING_MIN_TRANSACTIONS}),
flows as (select s.entity_id as payer, o.entity_id as payee from (select entity_id, unnest(output_addresses) as address from spend) s join owners o using (address) where o.entity_id <> s.entity_id),
fo as (select payer as entity_id, count(distinct payee) as fan_out from flows group by 1), fi as (select payee as entity_id, count(*) as n_received, count(distinct payer) as fan_in from flows group by 1),
sz as (select entity_id, count(*) as n_addresses from owners group by 1),
ch as (select entity_id, max(hops) as chain_hops, min(median_peel) as chain_median_peel, max(laundering_like::int) as chain_laundering_like from heads where entity_id is not null group by 1),
mx as (select entity_id, avg(is_coinjoin::int) as coinjoin_share from spend join flags using (txid) group by 1),
ld as (select {_id('entity_id')} as entity_id, max(coalesce(significant, false)::int) as has_attribution, max(hits / nullif(transactions, 0)) as first_relay_share, max(n_countries) as n_countries, max(n_asns) as n_asns, max(top_asn_share) as top_asn_share from leads group by 1)
select entity_id, """
    + ", ".join(
        f"round(coalesce({'n_transactions / nullif(days, 0)' if f == 'tx_per_active_day' else f}, {1 if f == 'n_addresses' else 0})::double, {1 if f in ('total_out', 'mean_value', 'median_value', 'value_spread', 'mean_fee', 'fee_spread') else 6}) as {f}" for f in K.FEATURES
    )
    + " from base left join sz using (entity_id) left join fo using (entity_id) left join fi using (entity_id) left join ch using (entity_id) left join mx using (entity_id) left join ld using (entity_id)"
)

SQL: dict[str, str] = {
    "keep_first_observation": f"select * exclude _n from (select *, row_number() over (partition by txid, ts_micro, src_ip order by {_nulls_last(_REST)}) as _n from net_l2) where _n = 1",
    "duplicate_counts": "select sum(n)::bigint as n_rows, count(*) as n_keys, (sum(n) - count(*))::bigint as n_duplicates from (select count(*) as n from net_l2 group by txid, ts_micro, src_ip)",
    "arrival_ranks": _with("l2") + f"select txid, ts_micro, src_ip, {_RANKED} as rank from l2",
    "earliest_observation": f"select txid, ts_micro, src_ip, src_port, dst_ip from (select *, {_RANKED} as r from net_l2) where r = 1",
    "derived_totals": _with("tx") + "select txid, len(input_addresses) as n_inputs, len(output_addresses) as n_outputs, coalesce(list_sum(input_amounts), 0)::bigint as total_in, coalesce(list_sum(output_amounts), 0)::bigint as total_out from tx",
    "conservation_check": _with("tx")
    + """select txid, gap, aligned from (select txid, (coalesce(list_sum(input_amounts), 0) - coalesce(list_sum(output_amounts), 0) - fee)::bigint as gap,
      len(input_addresses) = len(input_amounts) and len(output_addresses) = len(output_amounts) as aligned from tx) where coalesce(gap, 0) <> 0 or not aligned""",
    "provenance_counts": "select count(*) as observations, count(*) filter (country_source = 'db' and asn_source = 'db') as geo_from_database, count(*) - count(*) filter (country_source = 'db' and asn_source = 'db') as geo_from_record from net_l2",
    "sampled_transactions": _with("tx") + "select txid, ts_micro from tx order by md5('sample-42-' || txid) limit 60",
    "coinjoin_flags": _with("flags") + "select * from flags",
    "change_guesses": _with("guess") + "select * from guess",
    "first_seen_spent": _with("seen") + "select address, seen.t as seen_at, seen.x as seen_in, spent_at from seen",
    "cospend_clusters": _with("groups") + "select * from groups",
    "cluster_ids": _with("groups") + """select address, 'C-' || "group"[1:12] as cluster_id, (count(*) over (partition by "group"))::int as cluster_size, "group" from groups""",
    "peel_successors": _with("succ") + "select * from succ",
    "peel_chains": _with("chain") + "select * from chain",
    "chain_steps": _with("chain1") + "select start, txid, next_txid from (select start, txid, lead(txid) over (partition by start order by hop) as next_txid from chain1) where next_txid is not null",
    "money_flow": _with("flow") + "select * from flow",
    "first_seen_from": _with("seenfrom") + "select * from seenfrom",
    "built_edges": _with("flow", "hosts")
    + """select 'SENT_TO' as label, source, target, amount, observations from flow union all select 'SEEN_FROM', entity_id, src_ip, 0, n from seenfrom union all select 'IN_ASN', src_ip, network, 0, 0 from hosts""",
    "built_nodes": _with("owners", "hosts")
    + """select id, label, name, weight from (select *, row_number() over (partition by id order by r) as _n from (
      select entity_id as id, 'ENTITY' as label, entity_id as name, count(*) as weight, 0 as r from owners group by 1
      union all select src_ip, 'IP', src_ip, n, 1 from hosts
      union all select network, 'ASN', network || ' (' || coalesce(arg_min(country, src_ip), '') || ')', 0, 2 from (select network, src_ip, country from hosts) group by 1)) where _n = 1""",
    "k_hop": f"""with ways as ({_WAYS}), f as (select * from {_FOCUS}), one as (select id, 0 as depth from f union all select b, 1 from ways join f on a = id where b is not null),
      two as (select * from one union all select b, 2 from ways join one on a = id where depth = 1 and b is not null)
      select id, min(depth)::int as depth from two group by 1""",
    "dangling_edges": f"""with n as (select distinct {_id('id')} as k from graph_nodes), e as (select distinct id, {_id('source')} as source, {_id('target')} as target from graph_edges)
      select id, source, target from e where not exists (select 1 from n where k = source) or not exists (select 1 from n where k = target)""",
    "top_nodes": _with("nodes1") + "select id, label, weight from nodes1 order by weight desc nulls last, id limit 20",
    "large_entity_transactions": _with("txent") + "select txid, entity_id from txent where entity_id in (select entity_id from txent group by 1 having count(*) >= 10)",
    "origin_leads": _with("lead")
    + "select entity_id, ip, hits, transactions, round(rank_weight, 6) as rank_weight, round(baseline, 9) as baseline, round(log10(greatest(p, 1e-300)), 4) as log_p, round(log10(greatest(adj, 1e-300)), 4) as log_adjusted_p, significant, (select count(*) from tested) as tests from lead",
    "best_leads": _with("lead")
    + "select entity_id, ip, meta.asn as asn, meta.country as country, hits, transactions, significant from (select *, row_number() over (partition by entity_id order by adj, first_at.t, first_at.r, ip) as r from lead) where r = 1",
    "geo_concentration": _with("geo")
    + """select a.entity_id, n_countries, n_asns, round(cs, 9) as top_country_share, round(as_, 9) as top_asn_share
      from (select entity_id, count(country) as n_countries, max(n) / sum(n) as cs from (select entity_id, country, count(*) as n from geo group by 1, 2) group by 1) a
      join (select entity_id, count(asn) as n_asns, max(n) / sum(n) as as_ from (select entity_id, asn, count(*) as n from geo group by 1, 2) group by 1) b using (entity_id)""",
    "entity_features": _FEATURE_SQL,
    "majority_cluster": _with("owners")
    + f"""select entity_id, cluster_id, n from (select *, row_number() over (partition by entity_id order by n desc, cluster_id) as r from (
      select entity_id, cluster_id, count(*) as n from owners join (select distinct {_address('address')} as address, {_id('cluster_id')} as cluster_id from clusters) c using (address) where cluster_id is not null group by 1, 2)) where r = 1""",
    "pairwise_scores": _with("owners")
    + f""", j as (select entity_id, cluster_id from owners join (select {_address('address')} as address, min({_id('cluster_id')}) as cluster_id from clusters where {_address('address')} is not null and {_id('cluster_id')} is not null group by 1) c using (address)),
      b as (select sum(n * (n - 1) / 2) as v from (select count(*) as n from j group by entity_id, cluster_id)), p as (select sum(n * (n - 1) / 2) as v from (select count(*) as n from j group by cluster_id)), a as (select sum(n * (n - 1) / 2) as v from (select count(*) as n from j group by entity_id))
      select round(b.v / p.v, 9) as precision, round(b.v / a.v, 9) as recall, round(2 * (b.v / p.v) * (b.v / a.v) / (b.v / p.v + b.v / a.v), 9) as f1 from b, p, a""",
    "risk_metrics": _with("scored")
    + """, k as (select risk_score as s, label::bigint as y from scored where risk_score is not null and label is not null),
      per_score as (select s, count(*) as n, sum(y) as pos from k group by 1), st as (select *, sum(pos) over (order by s desc) / sum(n) over (order by s desc) as prec from per_score),
      t as (select sum(n) as n, sum(pos) as pos, sum(n) filter (s >= 0.5) as fl, sum(pos) filter (s >= 0.5) as hit, sum(prec * pos) as area from st)
      select n::bigint as n, round(pos / n, 9) as prevalence, round(coalesce(hit / nullif(fl, 0), 0), 9) as precision, round(coalesce(hit / nullif(pos, 0), 0), 9) as recall, round(coalesce(2 * (hit / fl) * (hit / pos) / nullif(hit / fl + hit / pos, 0), 0), 9) as f1, round(coalesce(area / nullif(pos, 0), 0), 9) as average_precision from t""",
    "alerts": _with("scored", "led", "owned", "heads") + _ALERTS,
    "alerts_filtered": _with("scored", "led", "owned")
    + f"""select s.entity_id, s.risk_score, l.ip, o.n as n_addresses from scored s join led l using (entity_id) left join (select entity_id, count(*) as n from owned group by 1) o using (entity_id)
      where l.significant and s.risk_score >= 0.25 and {_BAND} in ('High', 'Critical')""",
    "entity_addresses": _with("owned") + f"select address from owned where entity_id = {_BUSIEST}",
    "entity_transactions": _with("owned", "tx") + f"select txid, ts_micro, total_out, fee, n_inputs, n_outputs, script_type from tx join owned on owned.address = tx.input_addresses[1] where entity_id = {_BUSIEST}",
    "entity_chains": _with("owned", "heads") + f"select chain_id, hops, peeled_sats as peeled, median_peel, laundering_like from heads where entity_id = {_BUSIEST}",
    "entity_candidates": _with("owned", "led") + f"select ip, country, asn, hits, transactions, confidence, adjusted_p, significant from led where entity_id = {_BUSIEST}",
    "entity_observations": _with("owned", "tx")
    + f"""select * from (select distinct txid, src_ip, arrival_rank, ts_micro, geo_country, asn from net_l2 where txid in (select txid from tx join owned on owned.address = tx.input_addresses[1] where entity_id = {_BUSIEST}))
      order by ts_micro nulls last, txid, arrival_rank, src_ip limit 400""",
    "summary_totals": _with("tx", "l2", "owned", "scored", "led", "heads")
    + f"""select (select count(*) from tx) as transactions, (select count(*) from l2) as observations, (select count(*) from owned) as addresses, (select count(distinct entity_id) from owned) as entities,
      (select count(*) from scored) as scored, (select count(*) from scored where risk_score >= {_HIGH}) as high_risk, (select count(*) from led where significant) as attributed, (select count(distinct country) from led where significant) as countries,
      (select count(*) from heads) as chains, (select count(*) from heads where laundering_like) as laundering_chains""",
    "geo_rollup": _with("scored", "led") + f"select country, asn, count(*) as entities, round(avg(risk_score), 9) as mean_risk from {_LED_SCORES} where significant group by 1, 2",
    "risk_bands": _with("scored") + f"select {_BAND} as band, count(*) as n from scored group by 1",
    "countries": _with("scored", "led") + f"select country, count(*) as entities, count(*) filter (risk_score >= {_HIGH}) as high_risk from {_LED_SCORES} where significant and country is not null group by 1",
    "networks_topk": _with("scored", "led") + f"select asn, min(country) as country, count(*) as entities, round(avg(risk_score), 9) as mean_risk, sum(hits)::bigint as sightings from {_LED_SCORES} where significant group by 1 order by entities desc, asn nulls last limit 15",
    "hourly_activity": _with("txent", "scored")
    + f"select hour(make_timestamp(ts_micro)) as hour, count(*) filter (coalesce(risk_score >= {_HIGH}, false)) as high_risk, count(*) filter (not coalesce(risk_score >= {_HIGH}, false)) as other from tx join txent using (txid) join scored using (entity_id) where ts_micro is not null group by 1",
    "chain_list": _with("heads", "scored") + "select chain_id, h.entity_id, hops, peeled_sats as peeled, median_peel, peel_spread, laundering_like, risk_score as risk from heads h left join scored s on s.entity_id = h.entity_id",
    "longest_chain": _with("heads") + "select max(hops) as hops from heads",
    "chain_hops": _with("chain", "tx") + "select hop, txid, carried_address, total_out, fee, ts_micro from chain left join tx using (txid) where chain_id = (select chain_id from chain where hop = 0 order by laundering_like desc, hops desc, start limit 1)",
    "coinjoins": _with("flags") + "select txid, coinjoin_reason, n_inputs, n_outputs, total_out from flags join tx using (txid) where is_coinjoin",
    "attributed_hosts": _with("led") + "select entity_id, ip, country, asn, coalesce(n_countries, 0) > 1 as rotating from led where significant",
}
SQL |= {
    "seen_and_booked": "select txid from tx_l1 intersect select txid from net_l2",
    "seen_only": "select txid from net_l2 except select txid from tx_l1",
    "lead_rows": _with("led")
    + """select entity_id, case when length(entity_id) > 12 then entity_id[1:12] || '…' else entity_id end as short_id, coalesce(hits || '/' || transactions, '—') as first_relays,
      case when asn is null or asn = 0 then '—' else 'AS' || asn end as network, coalesce(country, '—') as country from led""",
    "risk_factors": _with("scored")
    + """select entity_id, f.name as name, f."group" as "group", f.contribution as contribution from (select entity_id, unnest(from_json(nullif(factors, ''), '[{"name": "VARCHAR", "group": "VARCHAR", "contribution": "DOUBLE"}]')) as f from scored where factors is not null)""",
    "geo_enrich": _with("l2")
    + f""", known as (select *, split_part(cidr, '/', 2)::int as bits from (values {', '.join("(" + ', '.join('null' if x is None else repr(x) for x in r) + ")" for r in RANGES)}) t(cidr, country, asn, asn_org)),
      place as (select x, case when regexp_full_match(x, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') then list_reduce(list_transform(string_split(x, '.'), lambda o: printf('%08b', o::int)), lambda a, b: a || b)
        when regexp_full_match(x, '[0-9A-Fa-f:]*:[0-9A-Fa-f:]*') then 'v6' || list_reduce(list_transform(string_split(l.g || ':' || repeat('0:', 8 - l.n - r.n) || r.g, ':').list_filter(lambda o: o <> ''), lambda o: printf('%016b', ('0x' || o)::int)), lambda a, b: a || b) end as bin
        from (select distinct src_ip as x from l2 union select split_part(cidr, '/', 1) from known),
        lateral (select split_part(x, '::', 1) as g, len(list_filter(string_split(split_part(x, '::', 1), ':'), lambda o: o <> '')) as n) l,
        lateral (select split_part(x, '::', 2) as g, len(list_filter(string_split(split_part(x, '::', 2), ':'), lambda o: o <> '')) as n) r),
      net as (select bits, country, asn, asn_org, left(bin, bits + if(bin[1] = 'v', 2, 0)) as head from known join place on x = split_part(cidr, '/', 1)),
      met as (select x as src_ip, bits, country, asn, asn_org from place join net on starts_with(bin, head)),
      hit as (select src_ip, arg_max(country, bits) filter (country is not null) as c, arg_max(asn, bits) filter (asn is not null) as a, arg_max(asn_org, bits) filter (asn is not null) as g from met group by 1)
      select txid, src_ip, arrival_rank, ts_micro, coalesce(c, geo_country) as geo_country, coalesce(a, asn)::bigint as asn, case when a is not null then coalesce(g, '') else '' end as asn_org,
        if(c is not null, 'db', 'record') as country_source, if(a is not null, 'db', 'record') as asn_source from l2 left join hit using (src_ip)""",
    "subgraph_nodes": _with("owned", "nodes1", recursive=False)
    + f""", edges1 as (select distinct * from graph_edges), near as (select {_BUSIEST} as id, 0 as depth union all select target, 1 from edges1 where source = {_BUSIEST} and target is not null union all select source, 1 from edges1 where target = {_BUSIEST} and source is not null),
      kept as (select id, min(depth) as depth from near group by 1 order by depth, id limit 60)
      select n.id, label, name, weight, n.id = {_BUSIEST} as focus from nodes1 n where n.id in (select id from kept)""",
    "subgraph_edges": _with("owned")
    + f""", edges1 as (select distinct * from graph_edges), near as (select {_BUSIEST} as id, 0 as depth union all select target, 1 from edges1 where source = {_BUSIEST} and target is not null union all select source, 1 from edges1 where target = {_BUSIEST} and source is not null),
      kept as (select id, min(depth) as depth from near group by 1 order by depth, id limit 60)
      select id, label, source, target, printf('%.4f', amount / 1e8) as btc, observations as seen from edges1 where source in (select id from kept) and target in (select id from kept)""",
    "pipeline_stats": _with("tx", "l2", "owned", "flags", "heads", "led", "scored")
    + """select 'Ingest' as stage, 'tx_l1 + net_l2' as tables, format('{:,} transactions, {:,} network sightings', (select count(*) from tx), (select count(*) from l2)) as summary
      union all select 'Clustering', 'clusters + tx_flags', format('{:,} clusters, {:,} CoinJoins filtered', (select count(distinct cluster_id) from owned), (select count(*) from flags where is_coinjoin))
      union all select 'Graph', 'entities + chains', format('{:,} entities, {:,} chains recovered', (select count(distinct entity_id) from owned), (select count(*) from heads))
      union all select 'Fusion', 'leads', format('{:,} significant attributions of {:,} scored', (select count(*) from led where significant), (select count(*) from led))
      union all select 'Models', 'scores', format('{:,} entities scored, {:,} flagged as anomalous', (select count(*) from scored), (select count(*) from scored where is_anomaly))""",
}
SQL["hourly_long"] = f"with h as ({SQL['hourly_activity']}) select hour, 'high_risk' as kind, high_risk as n from h union all select hour, 'other', other from h"
SQL |= {
    "budgeted_clusters": _with("merged") + """select address, coalesce(into_name, "group") as "group" from groups left join merged on name = "group\"""",
    "folded_entities": _with("folded") + "select * from folded",
    "folded_entities_low": _with("folded", low=True) + "select * from folded",
    "coinjoin_flags_low": _with("flags", low=True) + "select * from flags",
    "coinjoins_low": _with("flags", "tx", low=True) + "select txid, coinjoin_reason, n_inputs, n_outputs, total_out from flags join tx using (txid) where is_coinjoin",
    "peel_chains_low": _with("chain", low=True) + "select * from chain",
    "chain_steps_low": _with("chain1", low=True) + "select start, txid, next_txid from (select start, txid, lead(txid) over (partition by start order by hop) as next_txid from chain1) where next_txid is not null",
    "best_leads_low": _with("lead", low=True) + "select entity_id, ip, hits, transactions, significant from (select *, row_number() over (partition by entity_id order by adj, first_at.t, first_at.r, ip) as r from lead) where r = 1",
    "alerts_low": _with("scored", "led", "owned", "heads", low=True) + _ALERTS,
    "alerts_laundering_low": _with("scored", "heads", low=True) + "select s.entity_id, s.risk_score, max(hops) as chain_hops, bool_or(laundering_like) as laundering_like from scored s join heads h on h.entity_id = s.entity_id group by 1, 2 having bool_or(laundering_like)",
    "entity_chains_low": _with("heads", low=True)
    + "select chain_id, hops, peeled_sats as peeled, median_peel, laundering_like from heads where entity_id = (select entity_id from heads where entity_id is not null order by hops desc, start limit 1)",
    "chain_list_low": _with("heads", "scored", low=True) + "select chain_id, h.entity_id, hops, peeled_sats as peeled, median_peel, peel_spread, laundering_like, risk_score as risk from heads h left join scored s on s.entity_id = h.entity_id",
    "chain_hops_low": _with("chain", "tx", low=True)
    + "select hop, txid, carried_address, total_out, fee, ts_micro from chain left join tx using (txid) where chain_id = (select chain_id from chain where hop = 0 order by laundering_like desc, hops desc, start limit 1)",
}
