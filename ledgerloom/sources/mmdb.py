"""Binary address databases (``.mmdb``, the public MaxMind DB format) as tables of address ranges.

A file is a binary search tree over address bits, whose leaves point into a section of typed records.  It is read once, by one
task, from front to back of the tree, and comes out as rows (cidr, country, asn, asn_org) for ``geo.enrich``.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: the mark before the metadata, the gap between tree and records
_MARK, _GAP = b"\xab\xcd\xefMaxMind.com", 16
#: Rows handed on at a time.
BATCH = 50_000

SCHEMA = "database_type string, build_epoch bigint, path string, cidr string, country string, asn bigint, asn_org string"


def _value(data: bytes, at: int, base: int) -> tuple[object, int]:
    """The typed value at a place and the place after it; pointers count from ``base``."""
    control = data[at]
    kind, at = control >> 5, at + 1
    if kind == 1:  # a pointer of 11, 19, 27 or 32 bits
        width = (control >> 3 & 3) + 1
        number = int.from_bytes(data[at : at + width], "big")
        target = number if width == 4 else (control & 7) << 8 * width | number
        return _value(data, base + target + (0, 2048, 526336, 0)[width - 1], base)[0], at + width
    if kind == 0:
        kind, at = data[at] + 7, at + 1
    size = control & 31
    if size >= 29:
        extra = size - 28
        size = (29, 285, 65821)[extra - 1] + int.from_bytes(data[at : at + extra], "big")
        at += extra
    if kind == 7:
        out = {}
        for _ in range(size):
            key, at = _value(data, at, base)
            out[key], at = _value(data, at, base)
        return out, at
    if kind == 11:
        items = []
        for _ in range(size):
            item, at = _value(data, at, base)
            items.append(item)
        return items, at
    if kind == 14:
        return bool(size), at
    raw, at = data[at : at + size], at + size
    if kind == 2:
        return raw.decode("utf-8", "replace"), at
    if kind in (3, 15):
        return struct.unpack(">d" if kind == 3 else ">f", raw)[0], at
    if kind == 8:
        return int.from_bytes(raw, "big", signed=size == 4), at
    return (raw if kind == 4 else int.from_bytes(raw, "big")), at


def metadata(data: bytes) -> dict:
    """The metadata record; ValueError if the content is no such database."""
    at = data.rfind(_MARK)
    if at < 0:
        raise ValueError("no address database")
    at += len(_MARK)
    return _value(data, at, at)[0]


def networks(data: bytes) -> Iterator[tuple[str, dict]]:
    """(prefix, record) of every leaf.  In a tree of 128 bits the addresses of IPv4 are those whose first 96 bits are zero; other
    branches that lead into the same part of the tree repeat it and are left out."""
    about = metadata(data)
    count, width, six = about["node_count"], about["record_size"], about["ip_version"] == 6
    step, base = width // 4, about["node_count"] * width // 4 + _GAP
    bits = 128 if six else 32

    def child(node: int, right: int) -> int:
        at = node * step
        if width == 28:
            middle = data[at + 3]
            high = middle & 15 if right else middle >> 4
            start = at + 4 if right else at
            return high << 24 | int.from_bytes(data[start : start + 3], "big")
        half = width // 8
        return int.from_bytes(data[at + right * half : at + (right + 1) * half], "big")

    start4 = 0
    for _ in range(96 if six else 0):
        start4 = child(start4, 0) if start4 < count else start4
    records: dict[int, dict] = {}
    stack = [(0, 0, 0)]  # node, address bits so far, their number
    while stack:
        node, prefix, depth = stack.pop()
        if node < count:
            if six and node == start4 and prefix:
                continue
            if depth < bits:
                stack += [(child(node, right), prefix << 1 | right, depth + 1) for right in (1, 0)]
            continue
        if node == count:
            continue  # nothing is known
        if node not in records:
            records[node] = _value(data, base - _GAP + node - count, base)[0]
        if not six or (prefix == 0 and depth <= 96) or prefix.bit_length() <= depth - 96:
            low = prefix << (32 - max(0, depth - (bits - 32))) if depth > bits - 32 else 0
            yield f"{ipaddress.IPv4Address(low)}/{max(0, depth - (bits - 32))}", records[node]
        if six and not (depth > 96 and prefix.bit_length() <= depth - 96):
            yield f"{ipaddress.IPv6Address(prefix << (128 - depth))}/{depth}", records[node]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for b in batches:
        for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
            about, out = metadata(content), []
            kind, built = about.get("database_type", ""), about.get("build_epoch", 0)
            for cidr, record in networks(content):
                country = (record.get("country") or {}).get("iso_code")
                out.append((kind, built, path, cidr, country, record.get("autonomous_system_number"), record.get("autonomous_system_organization")))
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(cidr, country, asn, asn_org) of the databases in a folder, told apart by their metadata, whatever their names.

    A database whose type holds ``ASN`` gives networks, one whose type holds ``City`` or ``Country`` countries; others
    give nothing.  Of several of a kind the one built last counts (then the greatest path).  A record without the field is a miss.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mmdb").load(folder).select("path", "content")
    every = files.mapInArrow(_rows, SCHEMA)
    kind = F.when(F.contains("database_type", F.lit("ASN")), "asn").when(F.contains("database_type", F.lit("City")) | F.contains("database_type", F.lit("Country")), "country")
    known = every.withColumn("kind", kind).where("(kind = 'asn' and asn is not null) or (kind = 'country' and country is not null)")
    # of a kind, one file: there are few, so which is a broadcast of two rows
    newest = known.groupBy("kind").agg(F.max(F.struct("build_epoch", "path")).alias("newest"))
    kept = known.join(F.broadcast(newest), "kind").where(F.struct("build_epoch", "path") == F.col("newest"))
    is_asn = F.col("kind") == "asn"
    return kept.select("cidr", F.when(~is_asn, F.col("country")).alias("country"), F.when(is_asn, F.col("asn")).alias("asn"), F.when(is_asn, F.coalesce("asn_org", F.lit(""))).alias("asn_org"))
