"""Exact spans shared between documents, by hashing units of text and grouping the digests globally.

Lines and paragraphs find passages that begin and end with a unit.  A shared passage may begin anywhere, so the
default unit is cut by content: of all stretches of ``UNIT`` characters, those whose hash is the least within a window.
Any stretch of ``least`` characters holds such a unit, and it holds the same ones in every document, so documents
that share a stretch meet in the group of a digest.  The members of a small group are compared with the text around the
unit.  Around the members of a large one (a footer, a licence) every window of ``least`` characters that holds the unit is hashed
to 128 bits and these digests are grouped in turn, so the work is linear in the members, whatever they have in common; of
``WIDE`` neighbouring windows the stretch that all of them hold is grouped first, and only where it recurs are the windows.

The earliest ranked occurrence (least doc_id, then least offset) of a passage is kept, later ones are removed, with
their original offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize, slots
from ..skew import join_groups, lookup

#: Characters of a unit (a power of two times 1.5 keeps hashing short) and the length that passages have at least.
UNIT, LEAST = 96, 200
#: Document ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a digest's group that are compared with one another; larger groups are settled by digests of windows.
PAIRWISE = 128
#: Neighbouring windows that are first tried together by what they have in common.
WIDE = 15
#: Members of a class of documents whose pairs are listed in one task; larger classes are listed chunk by chunk.
CHUNK = 512

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _A
    x += right
    x ^= x >> np.uint64(32)
    x *= _B
    return x


def window_digests(points: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests, as two halves, of all stretches of ``length`` code points, from hashes of 1, 2, 4, ... of them."""
    n = len(points) - length + 1
    out = []
    for seed in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)):
        h = (points.astype(np.uint64) + np.uint64(1)) * seed
        h ^= h >> np.uint64(31)
        h *= _B ^ seed
        whole, done, size = None, 0, 1
        while True:
            if length & size:
                part = h[done : done + n]
                whole = part if whole is None else _join(whole, part ^ (part >> np.uint64(29)))
                done += size
            if done == length:
                break
            h = _join(h[:-size], h[size:])
            size *= 2
        out.append(whole.view(np.int64))
    return out[0], out[1]


def unit_hashes(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of all stretches of UNIT = 64 + 32 code points, by doubling."""
    h = points.astype(np.uint64)
    h += np.uint64(1)
    h *= _A
    h ^= h >> np.uint64(29)
    h *= _B
    size, half = 1, h
    while size < 64:
        h = _join(h[:-size], h[size:])
        size *= 2
        half = h if size == 32 else half
    return _join(h[:-32], half[64:])


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the leftmost minimum of some window of ``width`` values."""
    value, at, size = h, np.arange(len(h), dtype=np.int32), 1

    def least(value: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = value[shift:] < value[:-shift]
        return np.where(right, value[shift:], value[:-shift]), np.where(right, at[shift:], at[:-shift])

    while size * 2 <= width:
        value, at = least(value, at, size)
        size *= 2
    if size < width:
        value, at = least(value, at, width - size)
    return at[np.r_[True, at[1:] != at[:-1]]]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _units(least: int):
    width = least - UNIT + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, places, digests, held = [], [], [], 0
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                text = text.as_py()
                if text is None or len(text) < least:
                    continue
                h = unit_hashes(_points(text))
                at = window_minima(h, width)
                docs.append(np.full(len(at), doc, np.int64))
                places.append(at)
                digests.append(h[at].view(np.int64))
                held += len(at)
                if held > 500_000:
                    yield _batch(docs, places, digests)
                    docs, places, digests, held = [], [], [], 0
            if docs:
                yield _batch(docs, places, digests)

    return run


def _batch(docs: list, places: list, digests: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, places, digests)], names=["doc_id", "at", "digest"])


def representatives(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, first): texts of at least ``least`` characters that other documents repeat as a whole, first the least id."""
    texts = documents.where(F.length("text") >= least).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("digest"))
    texts = materialize(texts, "texts")
    firsts = materialize(texts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    return materialize(join_groups(texts, firsts, ["digest"]).select("doc_id", "first").distinct(), "copies")


def _without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents without those of ``ids``, by broadcast while there are at most BROADCAST_IDS."""
    return documents.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows."""
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _context(side: int):
    """Documents with the places of their shared units, one row per document: a row per unit with the text around it."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc, text, places in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["places"].to_pylist()):
                for p in places:
                    at, past = p["at"], p["at"] + UNIT
                    yield doc, at, p["digest"], text[max(0, at - side) : at], text[at:past], text[past : past + side]

    return lambda batches: _batches(rows(batches), ["doc_id", "at", "digest", "before", "unit", "after"], kinds)


_UNIT_ROW = "doc_id bigint, at int, digest bigint, before string, unit string, after string"


def _core_starts(least: int):
    """Starts of the cores around units: WIDE neighbouring windows that hold a unit have a core in common, which is the text from
    the last one's start to the first one's end; a window that several documents have has such a core in all of them."""
    side = least - UNIT
    wide = min(WIDE, side + 1)
    shifts = np.array([*range(0, side - wide + 1, wide), side - wide + 1])

    def starts(at: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        core = at[:, None] - shifts
        return core, (core >= 0) & (core - wide + 1 <= (n_chars - least)[:, None])

    return starts


def _window_starts(least: int):
    """Starts of the windows that hold a core."""
    back = np.arange(min(WIDE, least - UNIT + 1))

    def starts(core: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = core[:, None] - back
        return every, (every >= 0) & (every <= (n_chars - least)[:, None])

    return starts


def _digests(length: int, starts, chars: int = 1_000_000):
    """Documents with places, one row per document: the digests of the stretches of ``length`` at the starts that places give.

    Texts are hashed together, about ``chars`` at a time; a document has each start once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, texts, places = b["doc_id"].to_numpy(), b["text"].to_pylist(), b["places"].flatten().to_numpy().astype(np.int64)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            upto = np.r_[0, np.cumsum(pa.compute.list_value_length(b["places"]).to_numpy())]
            begins = np.cumsum(sizes) - sizes
            cuts = np.flatnonzero(np.r_[True, np.diff(begins // chars) > 0, True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                owner = np.repeat(np.arange(hi - lo), np.diff(upto[lo : hi + 1]))
                start, inside = starts(places[upto[lo] : upto[hi]], sizes[lo:hi][owner])
                found = np.unique((owner[:, None] << 32 | start)[inside])
                if not len(found):
                    continue
                owner, start = found >> 32, found & 0xFFFFFFFF
                high, low = window_digests(_points("".join(texts[lo:hi])), length)
                pick = (begins[lo:hi] - begins[lo])[owner] + start
                yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi][owner]), pa.array(start.astype(np.int32)), pa.array(high[pick]), pa.array(low[pick])], names=["doc_id", "start", "high", "low"])

    return run


_DIGEST_ROW = "doc_id bigint, start int, high bigint, low bigint"


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def _stretches(rows: list[tuple], least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc_a, doc_b, start_a, start_b, length): common stretches around the unit of a group's pairs of documents."""
    # occurrences with the same text around them are one class; they are alike in every comparison
    classes: dict[tuple[str, str, str], list[tuple[int, int]]] = {}
    for doc, at, *text in rows:
        classes.setdefault(tuple(text), []).append((doc, at))
    names = list(classes)
    turned = [x[0][::-1] for x in names]
    for i, x in enumerate(names):
        for j in range(i, len(names)):
            y = names[j]
            if x[1] != y[1]:
                continue  # two texts with one digest
            before = len(x[0]) if i == j else _common(turned[i], turned[j])
            length = before + UNIT + (len(x[2]) if i == j else _common(x[2], y[2]))
            if length < least:
                continue
            for doc_a, at_a in classes[x]:
                for doc_b, at_b in classes[y]:
                    if doc_a < doc_b:
                        yield doc_a, doc_b, at_a - before, at_b - before, length
                    elif doc_b < doc_a and i != j:
                        yield doc_b, doc_a, at_b - before, at_a - before, length


def _as_pairs(found: Iterator[tuple]) -> set[tuple]:
    return {(a, b) for a, b, *_ in found}


def _as_spans(found: Iterator[tuple]) -> set[tuple]:
    out = set()
    for a, b, start_a, start_b, length in found:
        out.add((a, start_a, start_a + length, False))
        out.add((b, start_b, start_b + length, True))
    return out


_PAIRS = "doc_a bigint, doc_b bigint", _as_pairs, [pa.int64(), pa.int64()]
_SPANS = "doc_id bigint, start bigint, end bigint, later boolean", _as_spans, [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def _compare(least: int, form: tuple):
    """Rows sorted by digest; a group, of PAIRWISE members at most, is held at a time."""
    schema, shape, kinds = form

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, group = None, []
        for b in batches:
            for digest, *row in zip(*(b[c].to_pylist() for c in ("digest", "doc_id", "at", "before", "unit", "after"))):
                if digest != key:
                    yield from shape(_stretches(group, least))
                    key, group = digest, []
                group.append(row)
        yield from shape(_stretches(group, least))

    return lambda batches: _batches(rows(batches), [c.split()[0] for c in schema.split(", ")], kinds, 50_000)


class Shared:
    """What the documents of a table have in common: stretches of ``least`` or more characters (code points).

    ``copies`` (doc_id, first) are documents whose whole text repeats another's; of equal texts only the least doc_id takes part in
    the rest.  ``around`` has the units of small groups with the text around them, ``windows`` (doc_id, start, high, low, first_doc,
    last_doc) the windows around units of large groups that stand in several documents, None where there are no large groups.
    Null, empty and shorter texts share nothing, nor do rows without a doc_id; a repeated row shares nothing with itself;
    texts of any length are read whole.
    """

    def __init__(self, documents: DataFrame, least: int = LEAST) -> None:
        self.documents, self.least = documents, least
        docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
        self.copies = representatives(docs, least)
        once = _without(docs.where(F.length("text") >= least), self.copies.where("doc_id <> first").select("doc_id"))
        units = materialize(once.mapInArrow(_units(least), "doc_id bigint, at int, digest bigint"), "units")
        groups = units.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
        groups = materialize(groups.select("digest", "n"), "groups")
        shared = materialize(join_groups(units, groups, ["digest"]).select("doc_id", "at", "digest", (F.col("n") > PAIRWISE).alias("large")), "shared")
        self.around = self._read(docs, shared.where("not large"), F.struct("at", "digest"), _context(least - UNIT), _UNIT_ROW)
        self.windows = None
        if not groups.where(F.col("n") > PAIRWISE).isEmpty():
            cores = self._in_several(docs, shared.where("large").withColumnRenamed("at", "start"), least - min(WIDE, least - UNIT + 1) + 1, _core_starts(least))
            if not cores.isEmpty():
                self.windows = self._in_several(docs, cores, least, _window_starts(least))

    @classmethod
    def _in_several(cls, docs: DataFrame, places: DataFrame, length: int, starts) -> DataFrame:
        """(doc_id, start, high, low, first_doc, last_doc): stretches of ``length`` at the starts that places (doc_id, start) give, if several documents have them."""
        every = materialize(cls._read(docs, places, F.col("start"), _digests(length, starts), _DIGEST_ROW), "digests")
        met = every.groupBy("high", "low").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).where("first_doc < last_doc")
        return materialize(join_groups(every, materialize(met, "met"), ["high", "low"]).drop("n"), "windows")

    @staticmethod
    def _read(docs: DataFrame, shared: DataFrame, place: Column, run, schema: str) -> DataFrame:
        """Texts are read again, for the documents of shared units only."""
        ids = shared.select("doc_id").distinct()
        texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        places = shared.groupBy("doc_id").agg(F.collect_list(place).alias("places"))
        return texts.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(run, schema)

    def _compared(self, form: tuple) -> DataFrame:
        grouped = self.around.repartition(slots(self.documents.sparkSession), "digest").sortWithinPartitions("digest")
        return grouped.mapInArrow(_compare(self.least, form), form[0])

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b, of documents with different texts."""
        found = self._compared(_PAIRS)
        if self.windows is not None:
            # windows that stand in the same documents are one class: a passage of any length is listed once
            held = materialize(self.windows.select("high", "low", "doc_id").distinct(), "held")
            sets = held.groupBy("high", "low").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"x{i}") for i in (1, 2)))
            classes = materialize(sets.groupBy("n", "x1", "x2").agg(F.min(F.struct("high", "low")).alias("w")).select("w.high", "w.low", "n"), "classes")
            found = found.unionByName(pairs_within(join_groups(held, classes, ["high", "low"]), ["high", "low"]))
        return materialize(found.distinct(), "pairs")

    def spans(self) -> DataFrame:
        """(doc_id, start, end, later): shared stretches of each document, later where a lesser doc_id has it too."""
        found = self._compared(_SPANS)
        if self.windows is not None:
            start = F.col("start").cast("bigint")
            found = found.unionByName(self.windows.select("doc_id", start.alias("start"), (start + self.least).alias("end"), (F.col("doc_id") > F.col("first_doc")).alias("later")))
        lengths = self.documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("end"))
        wholes = lengths.join(self.copies, "doc_id").select("doc_id", F.lit(0).cast("bigint").alias("start"), "end", (F.col("doc_id") > F.col("first")).alias("later"))
        return found.unionByName(wholes)


def pairs_within(members: DataFrame, key: list[str]) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of doc_ids with one key; ``n`` is the number of rows of the key.

    Rows are dealt to chunks of about CHUNK and each pair of chunks is joined by itself, so no task lists more than CHUNK squared.
    """
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = members.select(*key, "doc_id", chunks.alias("chunks"), F.pmod(F.xxhash64("doc_id"), chunks).cast("int").alias("chunk"))
    left = dealt.select(*key, F.col("doc_id").alias("a"), F.col("chunk").alias("one"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("two"))
    right = dealt.select(*key, F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), "chunk")).alias("one"), F.col("chunk").alias("two"))
    met = left.join(right, [*key, "one", "two"]).where("a < b or (one < two and a <> b)")
    return met.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def _members(pairs: DataFrame, side: str, copies: DataFrame) -> DataFrame:
    """``pairs`` with the representative in column ``side`` replaced by each of its copies, CHUNK of them a task."""
    sizes = copies.groupBy("first").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = copies.join(sizes, "first").select(F.col("first").alias(side), F.pmod(F.xxhash64("doc_id"), "chunks").cast("int").alias("chunk"), F.col("doc_id").alias("member"))
    spread = pairs.join(sizes.withColumnRenamed("first", side), side, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    other = next(c for c in ("doc_a", "doc_b") if c != side)
    return spread.join(dealt, [side, "chunk"], "left").select(F.coalesce("member", side).alias(side), other)


def sharing_pairs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of documents with a common stretch, pairs with and among copies included."""
    found = Shared(documents, least)
    every = _members(_members(found.pairs(), "doc_a", found.copies), "doc_b", found.copies)
    between = every.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"))
    sizes = materialize(found.copies.groupBy("first").agg(F.count("*").alias("n")), "sizes")
    return between.unionByName(pairs_within(join_groups(found.copies, sizes, ["first"]), ["first"]))


def merge_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end) with overlapping and touching spans of a document merged."""
    # at most one span per start, so a document has no more of them than characters
    once = spans.groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("doc_id").orderBy("start")
    reach = once.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    isles = reach.withColumn("isle", F.sum(F.when(F.col("before") >= F.col("start"), 0).otherwise(1)).over(order))
    return isles.groupBy("doc_id", "isle").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end")


def coverage(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_chars, shared_chars) of every document: its length and how much of it other documents share.

    A character counts once, if it lies in a stretch of ``least`` or more that stands in another document.  A null
    text has 0 characters.
    """
    spans = merge_spans(Shared(documents, least).spans())
    sums = spans.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    lengths = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    return lengths.join(sums, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"))


def removed_spans(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start, end) in original offsets: what goes if of each passage the earliest occurrence is kept."""
    return merge_spans(Shared(documents, least).spans().where("later"))


_BREAKS = {"line": r"\r\n|\n|\r", "paragraph": r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*"}


def _normal_units(unit: str, least: int):
    import hashlib
    import re

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks = re.compile(_BREAKS[unit])
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                text, start = text.as_py() or "", 0
                cuts = [(m.start(), m.end()) for m in breaks.finditer(text)] + [(len(text), len(text))]
                for end, after in cuts:
                    words = text[start:end].split()
                    normal = " ".join(words)
                    if len(normal) >= least:
                        out.append((doc, start, end - start, hashlib.blake2b(normal.lower().encode("utf-8", "surrogatepass"), digest_size=16).digest()))
                    start = after
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "start", "length", "digest"])

    return run


def repeated_units(documents: DataFrame, unit: str = "line", least: int = 40) -> DataFrame:
    """Lines or paragraphs that repeat an earlier one: doc_id, start, length, kept_doc, kept_start.

    Units are compared without regard to case and white space; units with fewer than ``least`` characters, once
    white space is collapsed, are left alone.  The earliest occurrence (least doc_id, then least start) is kept and has no row.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    units = materialize(docs.mapInArrow(_normal_units(unit, least), "doc_id bigint, start bigint, length bigint, digest binary"), "lines")
    first = units.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    first = materialize(first.select(F.hex("digest").alias("digest"), "kept"), "kept")
    met = lookup(units.withColumn("digest", F.hex("digest")), "digest", first, first.count(), "kept").where("kept is not null")
    return met.where((F.col("kept.doc_id") != F.col("doc_id")) | (F.col("kept.start") != F.col("start"))).select("doc_id", "start", "length", F.col("kept.doc_id").alias("kept_doc"), F.col("kept.start").alias("kept_start"))
