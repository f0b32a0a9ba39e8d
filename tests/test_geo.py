import ipaddress
import random

import pytest

from ledgerloom.sources import geo
from tests.conftest import rows

RANGES = [
    ("::/0", None, 1, "Everything"), ("2000::/3", "AA", None, None), ("2001:db8::/32", "BB", 64700, "Doc"), ("2001:db8:1::/48", None, 64701, None), ("2001:db8:1:70::/64", "CC", None, None),
    ("2001:DB8:1:70::4c/128", "DD", 64702, "One"), ("2001:db8:1:70:8000::/65", "EE", None, None), ("fd00::/8", "FF", None, None), ("::ffff:10.0.0.0/104", "MM", None, None),
    ("0.0.0.0/0", None, 2, "All4"), ("10.0.0.0/8", "ZZ", None, None), ("10.1.0.0/16", None, 64600, "Net"), ("10.1.200.7/32", "XX", None, None), ("nonsense/8", "NO", 9, None),
]
HOSTS = [
    "2001:db8:1:70::4c", "2001:0DB8:0001:0070:0:0:0:4C", "2001:db8:1:70::4d", "2001:db8:1:70:8000::1", "2001:db8:1:71::1", "2001:db8:2::", "2a00::1", "fd2a::ac4", "ffff::", "::", "::1", "1::8", "1:2:3:4:5:6:7::",
    "::ffff:10.1.2.3", "::ffff:a01:203", "1:2:3:4:5:6:7.8.9.10", "10.1.200.7", "10.1.200.8", "10.9.9.9", "9.9.9.9",
]
NO_HOSTS = ["", "x", ":", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "1:2:3:4::5:6:7:8", "12345::", "g::", "::1.2.3", "::1.2.3.256", "1.2.3.4::", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "10.1.2.03", " ::1", "::1\n", "1:", ":1"]


def brute(ip, country, asn):
    try:
        a = ipaddress.ip_address(ip)
    except ValueError:
        return (ip, country, asn, "", "record", "record")
    met = [(ipaddress.ip_network(r, strict=False), c, s, o) for r, c, s, o in RANGES if r != "nonsense/8"]
    met = sorted((m for m in met if m[0].version == a.version and a in m[0]), key=lambda m: -m[0].prefixlen)
    c = next((m[1] for m in met if m[1] is not None), None)
    s = next(((m[2], m[3] or "") for m in met if m[2] is not None), None)
    return (ip, c or country, s[0] if s else asn, s[1] if s else "", "db" if c else "record", "db" if s else "record")


@pytest.mark.parametrize("limit", [geo.BROADCAST_RANGES, 0])
def test_both_families_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(geo, "BROADCAST_RANGES", limit)
    rng = random.Random(4)
    near = [str(ipaddress.ip_address(int(ipaddress.ip_address("2001:db8:1:70::")) ^ (rng.getrandbits(64) << rng.randrange(60)))) for _ in range(60)]
    hosts = HOSTS + [h for h in NO_HOSTS if h != "fe80::1%eth0"] + near
    l2 = spark.createDataFrame([(h, "RR", 5) for h in hosts * 2], "src_ip string, geo_country string, asn bigint")
    table = spark.createDataFrame(RANGES, "cidr string, country string, asn bigint, asn_org string")
    got = rows(geo.enrich(l2, table), "src_ip", "geo_country", "asn", "asn_org", "country_source", "asn_source")
    assert got == sorted((brute(h, "RR", 5) for h in hosts * 2), key=str)


def test_addresses_as_digits(spark):
    df = spark.createDataFrame([(h,) for h in HOSTS + NO_HOSTS], "ip string")
    got = {r["ip"]: r["x"] for r in df.select("ip", geo.ipv6_hex(df.ip).alias("x")).collect()}
    assert got == {h: f"{int(ipaddress.IPv6Address(h)):032x}" if h in HOSTS and ":" in h else None for h in HOSTS + NO_HOSTS}


def test_a_table_of_one_family_leaves_the_other(spark):
    l2 = spark.createDataFrame([("2001:db8::1", "RR", 5), ("10.0.0.1", "RR", 5), (None, "RR", 5)], "src_ip string, geo_country string, asn bigint")
    for cidr, hit in (("2001:db8::/32", "2001:db8::1"), ("10.0.0.0/8", "10.0.0.1")):
        out = geo.enrich(l2, spark.createDataFrame([(cidr, "DB", None, None)], "cidr string, country string, asn bigint, asn_org string"))
        assert {r["src_ip"] for r in out.collect() if r["country_source"] == "db"} == {hit}
        assert out.count() == 3
