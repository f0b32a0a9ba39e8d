"""Queries of the general data problems p1 to p5 over the project's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..keys import clean_id
from ..operators import components, dense_counts, feature_blocks, orphans, quarantine

#: A key that holds at least one in so many rows of its table is reported as heavy (2 %).
HEAVY_ONE_IN = 50


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    def heavy(name: str, key: str) -> DataFrame:
        return dense_counts.heavy_keys(table(spark, d, name), clean_id(key), HEAVY_ONE_IN).select(F.lit(name).alias("table_name"), F.col("key").alias("key_value"))

    return heavy("entities", "entity_id").unionByName(heavy("net_l2", "src_ip"))


def p1_entity_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..keys import clean_address

    counts = dense_counts.per_key_counts(table(spark, d, "entities"), clean_id("entity_id"), clean_address("address"))
    return counts.select(F.col("key").alias("entity_id"), F.col("n").alias("n_rows"), F.col("items").alias("n_addresses"))


def p1_host_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = dense_counts.per_key_counts(table(spark, d, "net_l2"), clean_id("src_ip"), F.col("txid"), F.col("ts_micro"))
    return counts.select(F.col("key").alias("src_ip"), F.col("n").alias("sightings"), F.col("items").alias("n_txids"), F.col("first").alias("first_ts"), F.col("last").alias("last_ts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.address_groups(table(spark, d, "clusters"), table(spark, d, "entities"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    wide, n = feature_blocks.entity_features(table(spark, d, "tx_l1"), table(spark, d, "entities"))
    return feature_blocks.long_features(wide, n).select("entity_id", "event_type", "last_txid")


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    wide, n = feature_blocks.entity_features(table(spark, d, "tx_l1"), table(spark, d, "entities"))
    return feature_blocks.long_features(wide, n)


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """The complete entity table: number of types and events per entity, 0 without events."""
    wide, n = feature_blocks.entity_features(table(spark, d, "tx_l1"), table(spark, d, "entities"))
    every = F.concat(*(F.coalesce(f"block_{b}", F.array()) for b in range(n)))
    total = F.aggregate(F.transform(every, lambda x: x["n"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return wide.select("entity_id", F.size(every).cast("bigint").alias("n_types"), total.alias("n_events"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.invalid_rows(table(spark, d, "raw_observations"), table(spark, d, "raw_layout"))


def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.valid_rows(table(spark, d, "raw_observations"), table(spark, d, "raw_layout"))


def p4_typed(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows with their lists written out, an amount that is none as ``?``."""
    rows = p4_valid(spark, d)
    return rows.select(*(F.array_join(F.col(c).cast("array<string>"), ";", "?").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.reason_counts(table(spark, d, "raw_observations"), table(spark, d, "raw_layout"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*(table(spark, d, t) for t in ("graph_edges", "leads", "scores", "graph_nodes", "entities")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(p5_found(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_entity_counts, p1_host_counts, p2_found, p3_found, p3_features, p3_entities, p4_found, p4_valid, p4_typed, p4_counts, p5_found, p5_counts)
}


def _id(c: str) -> str:
    return f"nullif(trim({c}, ' '), '')"


def _address(c: str) -> str:
    return f"case when lower(left(trim({c}, ' '), 3)) = 'bc1' then lower(trim({c}, ' ')) else nullif(trim({c}, ' '), '') end"


_TYPE_COUNTS = f"""
with tx as (
  select distinct txid, ts_micro, {_address('input_addresses[1]')} as address, script_type, n_inputs, n_outputs, total_out, fee
  from tx_l1 where txid is not null and ts_micro is not null and script_type is not null
), owner as (
  select {_address('address')} as address, min({_id('entity_id')}) as entity_id from entities
  where {_address('address')} is not null and {_id('entity_id')} is not null group by 1
), counts as (
  select entity_id, script_type || ':' || n_inputs || ':' || n_outputs as event_type, count(*) as n, max(ts_micro) as last_ts,
    max(struct_pack(t := ts_micro, x := txid)).x as last_txid, cast(sum(total_out) as bigint) as total_out, cast(sum(fee) as bigint) as fee
  from tx join owner using (address) group by 1, 2
)
"""

_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})$"


def _digits_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(split_part({x}, '.', 1), '[+-]', '') || rpad(split_part({x}, '.', 2), 8, '0'), '^0+', '')"


def _sats_sql(x: str) -> str:
    return f"case when {_amount_sql(x)} then cast(if({x}[1] = '-', -1, 1) * cast('0' || {_digits_sql(x)} as hugeint) as bigint) end"


def _amounts_sql(x: str) -> str:
    return f"case when {x} = '' then '' else array_to_string(list_transform(string_split({x}, ';'), lambda a: coalesce({_sats_sql("trim(a, ' ')")}::varchar, '?')), ';') end"


def _port_sql(x: str) -> str:
    return f"case when regexp_full_match({x}, '[0-9]+') and coalesce(try_cast({x} as hugeint), 65536) <= 65535 then {x}::int end"


def _amount_sql(x: str) -> str:
    digits = _digits_sql(x)
    return rf"(regexp_full_match({x}, '[+-]?([0-9]+(\.[0-9]{{0,8}})?|\.[0-9]{{1,8}})') and case when length({digits}) < 19 then true when length({digits}) > 19 then false else {digits} <= if({x}[1] = '-', '9223372036854775808', '9223372036854775807') end)"


_JUDGED = rf"""
with lines as (
  select line_id, raw_line, regexp_full_match(raw_line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') as quoting
  from raw_observations
), parsed as (
  select *, list_transform(regexp_extract_all(',' || raw_line, '(?s),("([^"]|"")*"|[^",]*)', 1),
    lambda c: trim(case when c[1] = '"' then replace(c[2:-2], '""', '"') else c end, ' ')) as c from lines
), cells as (
  select *, c[1] as ts, c[3] as port, c[9] as ins, c[11] as fee_cell from parsed
), judged as (
  select line_id, c, case
    when raw_line is null then 'column_count'
    when not quoting then 'quoting'
    when len(c) <> (select count(*) from raw_layout) then 'column_count'
    when not regexp_full_match(ts, '{_FORM}') or try_cast(left(ts, 10) as date) is null or left(ts, 4) = '0000'
      or ts[12:13] > '23' or ts[15:16] > '59' or ts[18:19] > '59' or (ts[-1] <> 'Z' and (ts[-5:-4] > '23' or ts[-2:] > '59')) then 'timestamp'
    when port <> '' and not (regexp_full_match(port, '[0-9]+') and coalesce(try_cast(port as hugeint), 65536) <= 65535) then 'src_port'
    when ins <> '' and not list_bool_and(list_transform(string_split(ins, ';'), lambda a: {_amount_sql("trim(a, ' ')")})) then 'input_amounts'
    when not {_amount_sql('fee_cell')} then 'fee'
  end as reason from cells
)
"""

_UNMET = """
with refs as (
  select 'graph_edges' as t, 'source' as f, trim(id, ' ') as rk, 'graph_nodes' as p, trim(source, ' ') as k, loaded_at as a from graph_edges
  union select 'graph_edges', 'target', trim(id, ' '), 'graph_nodes', trim(target, ' '), loaded_at from graph_edges
  union select 'leads', 'entity_id', trim(entity_id, ' '), 'entities', trim(entity_id, ' '), loaded_at from leads
  union select 'scores', 'entity_id', trim(entity_id, ' '), 'entities', trim(entity_id, ' '), loaded_at from scores
), held as (
  select 'graph_nodes' as p, trim(id, ' ') as k, loaded_at as l, retired_at as r from graph_nodes
  union select 'entities', trim(entity_id, ' '), loaded_at, retired_at from entities
), found as (
  select distinct t as table_name, f as field_name, rk as row_key, refs.k as ref_key, strftime(a, '%Y-%m') as load_month,
    case when count(held.k) = 0 then 'missing' when min(l) > a then 'late' else 'deleted' end as absence
  from refs left join held on refs.p = held.p and refs.k = held.k where refs.k <> ''
  group by t, f, rk, refs.k, a having count(*) filter (l <= a and (r is null or r > a)) = 0
)
"""

SQL: dict[str, str] = {
    "p1_found": f"""
      select 'entities' as table_name, {_id('entity_id')} as key_value from entities group by 2
      having key_value is not null and count(*) * {HEAVY_ONE_IN} >= (select count(*) from entities)
      union all
      select 'net_l2', {_id('src_ip')} as k from net_l2 group by 2 having k is not null and count(*) * {HEAVY_ONE_IN} >= (select count(*) from net_l2)""",
    "p1_entity_counts": f"select {_id('entity_id')} as entity_id, count(*) as n_rows, count(distinct {_address('address')}) as n_addresses from entities where {_id('entity_id')} is not null group by 1",
    "p1_host_counts": f"""select {_id('src_ip')} as src_ip, count(*) as sightings, count(distinct txid) as n_txids, min(ts_micro) as first_ts, max(ts_micro) as last_ts
      from net_l2 where {_id('src_ip')} is not null group by 1""",
    "p2_found": f"""
      with recursive ties as (
        select distinct {_address('address')} as address, '1' || {_id('cluster_id')} as other from clusters
        union select distinct {_address('address')}, '2' || {_id('entity_id')} from entities
      ), pairs as (
        select distinct a.address as x, b.address as y from ties a
        join (select other, min(address) as address from ties where address is not null and other is not null group by 1) b on a.other = b.other where a.address is not null
      ), links as (select x, y from pairs union select y, x from pairs union select address, address from ties where address is not null),
      reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x)
      select x as address, min(y) as group_address from reach group by 1""",
    "p3_found": _TYPE_COUNTS + "select entity_id, event_type, last_txid from counts",
    "p3_features": _TYPE_COUNTS + "select entity_id, event_type, n, last_ts, last_txid, total_out, fee from counts",
    "p3_entities": _TYPE_COUNTS
    + f"""select e.entity_id, count(event_type) as n_types, cast(coalesce(sum(n), 0) as bigint) as n_events
      from (select distinct {_id('entity_id')} as entity_id from entities where {_id('entity_id')} is not null) e left join counts using (entity_id) group by 1""",
    "p4_found": _JUDGED + "select line_id, reason from judged where reason is not null",
    "p4_typed": _JUDGED
    + rf"""select line_id, epoch_us(strptime(left(t, 19), '%Y-%m-%dT%H:%M:%S')) + rpad(left(regexp_extract(t, '\.([0-9]+)', 1), 6), 6, '0')::bigint
        - if(t[-1] = 'Z', 0, (t[-5:-4]::bigint * 60 + t[-2:]::bigint) * 60000000 * if(t[-6] = '-', -1, 1)) as timestamp,
      c[2] as src_ip, {_port_sql('c[3]')} as src_port, c[4] as dst_ip, {_port_sql('c[5]')} as dst_port, c[6] as txid,
      array_to_string(list_transform(string_split(c[7], ';'), lambda a: trim(a, ' ')), ';') as input_addresses, array_to_string(list_transform(string_split(c[8], ';'), lambda a: trim(a, ' ')), ';') as output_addresses,
      {_amounts_sql('c[9]')} as input_amounts, {_amounts_sql('c[10]')} as output_amounts, {_sats_sql('c[11]')} as fee, c[12] as script_type, c[13] as geo_country,
      case when regexp_full_match(c[14], '[+-]?[0-9]+') then try_cast(c[14] as bigint) end as asn
      from (select line_id, c, if(reason is null, c[1], null) as t, reason from judged) where reason is null""",
    "p4_counts": _JUDGED + "select coalesce(reason, 'valid') as reason, count(*) as n from judged group by 1",
    "p5_found": _UNMET + "select * from found",
    "p5_counts": _UNMET + "select table_name, field_name, load_month, absence, count(*) as n from found group by 1, 2, 3, 4",
}
