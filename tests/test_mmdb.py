import ipaddress
import struct

import pytest

from ledgerloom.sources import geo, mmdb
from tests.conftest import rows


def packed(value):
    """A value in the format's types."""

    def head(kind, size):
        first = (kind << 5 if kind < 8 else 0) | min(size, 29)
        return bytes([first]) + (bytes([kind - 7]) if kind > 7 else b"") + (bytes([size - 29]) if size >= 29 else b"")

    if isinstance(value, dict):
        return head(7, len(value)) + b"".join(packed(k) + packed(v) for k, v in value.items())
    if isinstance(value, list):
        return head(11, len(value)) + b"".join(map(packed, value))
    if isinstance(value, bool):
        return head(14, int(value))
    if isinstance(value, str):
        return head(2, len(value.encode())) + value.encode()
    if isinstance(value, float):
        return head(3, 8) + struct.pack(">d", value)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return head(6 if value < 1 << 32 else 9, len(raw)) + raw


def database(kind, networks, version=6, width=24, built=1, alias=False):
    """A database with the networks, longer ones within shorter ones given last; ``alias`` leads a second branch to IPv4."""
    bits = 128 if version == 6 else 32
    tree, records = [[None, None]], b""
    for cidr, record in networks:
        net = ipaddress.ip_network(cidr)
        value, length = int(net.network_address), net.prefixlen + (96 if version == 6 and net.version == 4 else 0)
        node, at = 0, len(records)
        records += packed(record)
        for i in range(length):
            bit = value >> (bits - 1 - i) & 1
            if i == length - 1:
                tree[node][bit] = ("data", at)
            else:
                if not isinstance(tree[node][bit], int):
                    tree.append([tree[node][bit], tree[node][bit]])
                    tree[node][bit] = len(tree) - 1
                node = tree[node][bit]
    if alias:  # 8000::/1 leads to where IPv4 begins
        node = 0
        for _ in range(96):
            node = tree[node][0]
        tree[0][1] = node
    n = len(tree)
    number = lambda x: n if x is None else x if isinstance(x, int) else n + 16 + x[1]
    body = b""
    for left, right in tree:
        a, b = number(left), number(right)
        if width == 28:
            body += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([(a >> 24) << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            body += a.to_bytes(width // 8, "big") + b.to_bytes(width // 8, "big")
    about = {"node_count": n, "record_size": width, "ip_version": version, "database_type": kind, "build_epoch": built, "languages": ["en"], "binary_format_major_version": 2}
    return body + bytes(16) + records + b"\xab\xcd\xefMaxMind.com" + packed(about)


COUNTRY = [("10.0.0.0/8", {"country": {"iso_code": "ZZ", "names": {"en": "x" * 40}}}), ("10.1.0.0/16", {"country": {"iso_code": "YY"}, "location": {"latitude": 1.5, "eu": True}}), ("2001:db8::/32", {"country": {"iso_code": "BB"}}), ("10.9.0.0/16", {"continent": {}})]
ASN = [("10.1.0.0/17", {"autonomous_system_number": 64600, "autonomous_system_organization": "Net"}), ("2001:db8:1::/48", {"autonomous_system_number": 1 << 33})]


@pytest.mark.parametrize("width", [24, 28, 32])
@pytest.mark.parametrize("alias", [False, True])
def test_networks(width, alias):
    found = {ipaddress.ip_network(c): r for c, r in mmdb.networks(database("Test-City", COUNTRY, width=width, alias=alias))}

    def lookup(ip):
        a = ipaddress.ip_address(ip)
        return next((r.get("country", {}).get("iso_code") for n, r in found.items() if n.version == a.version and a in n), "miss")

    assert [lookup(ip) for ip in ("10.1.2.3", "10.2.0.1", "10.9.1.1", "11.0.0.1", "2001:db8::1", "2001:db9::1")] == ["YY", "ZZ", None, "miss", "BB", "miss"]
    assert not any(n.version == 6 and n.network_address < ipaddress.ip_address("1::") for n in found)


def test_ipv4_tree_and_broken_files():
    assert dict(mmdb.networks(database("x ASN", ASN[:1], version=4))) == {"10.1.0.0/17": ASN[0][1]}
    with pytest.raises(ValueError):
        mmdb.metadata(b"nothing of the kind")


def test_folder_of_databases(spark, tmp_path):
    (tmp_path / "b.mmdb").write_bytes(database("DBIP-Country-Lite", COUNTRY, built=5))
    (tmp_path / "old.mmdb").write_bytes(database("GeoLite2-City", [("10.0.0.0/8", {"country": {"iso_code": "OLD"}})], built=4))
    (tmp_path / "a.mmdb").write_bytes(database("GeoLite2-ASN", ASN))
    (tmp_path / "c.mmdb").write_bytes(database("Something-Else", COUNTRY, built=9))
    (tmp_path / "readme.txt").write_text("no database")
    hosts = ["10.1.2.3", "10.1.200.1", "10.9.0.1", "11.1.1.1", "2001:db8:1::7", "2001:db8:2::7", None, "x"]
    l2 = spark.createDataFrame([(h, "RR", 7, "", "record", "record") for h in hosts], "src_ip string, geo_country string, asn bigint, asn_org string, country_source string, asn_source string")
    got = rows(geo.enrich(l2, mmdb.read_folder(spark, str(tmp_path))))
    assert got == sorted(
        [
            ("10.1.2.3", "YY", 64600, "Net", "db", "db"), ("10.1.200.1", "YY", 7, "", "db", "record"), ("10.9.0.1", "RR", 7, "", "record", "record"), ("11.1.1.1", "RR", 7, "", "record", "record"),
            ("2001:db8:1::7", "BB", 1 << 33, "", "db", "db"), ("2001:db8:2::7", "BB", 7, "", "db", "record"), (None, "RR", 7, "", "record", "record"), ("x", "RR", 7, "", "record", "record"),
        ],
        key=str,
    )


def test_folder_without_databases(spark, tmp_path):
    assert rows(mmdb.read_folder(spark, str(tmp_path))) == []
