"""Geography of hosts, IPv4 and IPv6, from a table of address ranges: the longest prefix that holds an address.

A host is cut to every prefix length that the table has, so the lookup is an equi-join on (family, bits, leading bits):
as many rows a host as there are lengths, whatever the prefixes are, and short ones need no expansion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize

#: Rows of the range table that are broadcast at most.
BROADCAST_RANGES = 500_000

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
_IPV4 = rf"\A{_DOTTED}\z"
#: Groups and, in place of the last two, a dotted address.
_MIXED = rf"\A([0-9A-Fa-f:]*:){_DOTTED}\z"
_GROUP = r"\A[0-9A-Fa-f]{1,4}\z"


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as an integer, null for anything else."""
    return F.when(ip.rlike(_IPV4), _dotted_number(ip, _IPV4, 1))


def _dotted_number(text: Column, pattern: str, first: int) -> Column:
    octet = lambda i: F.regexp_extract(text, pattern, first + i).cast("bigint")
    return octet(0) * (1 << 24) + octet(1) * (1 << 16) + octet(2) * (1 << 8) + octet(3)


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, null for anything else; ``::`` stands for one group of zeros at least."""
    tail = F.lpad(F.hex(_dotted_number(ip, _MIXED, 2)), 8, "0")
    text = F.when(ip.rlike(_MIXED), F.concat(F.regexp_extract(ip, _MIXED, 1), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))).otherwise(ip)
    halves = F.split(text, "::", -1)
    groups = lambda i: F.when(F.coalesce(F.get(halves, F.lit(i)), F.lit("")) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.get(halves, F.lit(i)), ":", -1))
    left, right = groups(0), groups(1)
    n = F.size(left) + F.size(right)
    right_size = ((F.size(halves) == 1) & (n == 8)) | ((F.size(halves) == 2) & (n <= 7))
    digits = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")
    whole = F.forall(F.concat(left, right), lambda g: g.rlike(_GROUP))
    return F.when(right_size & whole, F.lower(F.concat(digits(left), F.repeat(F.lit("0000"), 8 - n), digits(right))))


def _placed(df: DataFrame, ip: str) -> DataFrame:
    """``df`` with family (4 or 6) and the address's 128 bits as hi and lo, an IPv4 address in the first 32; other rows are left out."""
    parsed = df.withColumns({"_v4": ipv4_number(F.col(ip)), "_v6": ipv6_hex(F.col(ip))}).where("_v4 is not null or _v6 is not null")
    half = lambda at: F.conv(F.substring("_v6", at, 16), 16, -10).cast("bigint")
    return parsed.withColumns({
        "family": F.when(F.col("_v4").isNotNull(), 4).otherwise(6),
        "hi": F.when(F.col("_v4").isNotNull(), F.shiftleft("_v4", 32)).otherwise(half(1)),
        "lo": F.when(F.col("_v4").isNotNull(), F.lit(0).cast("bigint")).otherwise(half(17)),
    }).drop("_v4", "_v6")


def _cut(df: DataFrame) -> DataFrame:
    """``df`` with hi and lo cut to their first ``bits`` bits."""
    # a shift by 64 is one by 0 in the JVM
    hi = F.expr("case when bits = 0 then 0L when bits >= 64 then hi else hi & shiftleft(-1L, 64 - bits) end")
    lo = F.expr("case when bits <= 64 then 0L else lo & shiftleft(-1L, 128 - bits) end")
    return df.withColumns({"hi": hi, "lo": lo})


def ranges(table: DataFrame) -> DataFrame:
    """(family, bits, hi, lo, country, asn, asn_org) from rows (cidr, country, asn, asn_org); what is no prefix is left out."""
    bits = F.split_part("cidr", F.lit("/"), F.lit(2)).cast("int")
    t = table.select("country", "asn", "asn_org", bits.alias("bits"), F.split_part("cidr", F.lit("/"), F.lit(1)).alias("_base"))
    return _cut(_placed(t, "_base").where("bits between 0 and if(family = 4, 32, 128)").drop("_base"))


def enrich(l2: DataFrame, table: DataFrame) -> DataFrame:
    """Sightings with geo_country, asn, asn_org and their sources ``db`` or ``record``, each field on its own.

    The most specific range that knows a field gives it; where none does, the record's own value stays and asn_org is
    empty.  Only src_ip is looked up, and each distinct one once; what is no address is a miss.  The families are apart:
    an IPv4-mapped IPv6 address is found in IPv6 ranges only.
    """
    cut = ranges(table)
    have = cut.groupBy("family", "bits").agg(F.count("*").alias("n")).collect()  # 162 rows at most
    lengths = lambda family: F.array(*(F.lit(r["bits"]) for r in have if r["family"] == family)).cast("array<int>")
    # written, else the filters on the parsed address are pushed below the distinct and every sighting is parsed
    hosts = _placed(materialize(l2.select("src_ip").where("src_ip is not null").distinct(), "hosts"), "src_ip")
    hosts = _cut(hosts.withColumn("bits", F.explode(F.when(F.col("family") == 4, lengths(4)).otherwise(lengths(6)))))
    met = hosts.join(F.broadcast(cut) if sum(r["n"] for r in have) <= BROADCAST_RANGES else cut, ["family", "bits", "hi", "lo"])
    best = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.struct(c, "asn_org")), F.when(F.col(c).isNotNull(), F.col("bits")))
    found = met.groupBy("src_ip").agg(best("country").alias("c"), best("asn").alias("a")).select("src_ip", F.col("c.country").alias("_country"), F.col("a.asn").alias("_asn"), F.col("a.asn_org").alias("_org"))
    kept = [c for c in l2.columns if c not in ("geo_country", "asn", "asn_org", "country_source", "asn_source")]
    out = l2.join(found, "src_ip", "left")
    return out.select(
        *kept,
        F.coalesce("_country", "geo_country").alias("geo_country"),
        F.coalesce("_asn", "asn").alias("asn"),
        F.when(F.col("_asn").isNotNull(), F.coalesce("_org", F.lit(""))).otherwise("").alias("asn_org"),
        F.when(F.col("_country").isNotNull(), "db").otherwise("record").alias("country_source"),
        F.when(F.col("_asn").isNotNull(), "db").otherwise("record").alias("asn_source"),
    )

