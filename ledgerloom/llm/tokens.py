"""Encoding a corpus with a public byte-level BPE vocabulary by a global shuffle of its distinct words.

1. Documents are cut into pre-tokens.  A pre-token that is itself a token takes its id from the vocabulary (a table
   of fixed size); of the others, each block of documents keeps the distinct words and every word's positions.
2. The blocks' words are shuffled by word, each distinct word is encoded once, and its ids are sent back to the blocks.
3. A block puts the ids at their positions and gives one list per document.

A word reaches the shuffle at most once per block, however often it occurs, and at most BLOCKS_PER_WORD times in one task: of
very many blocks every so many have words of their own.  Where only numbers of ids are asked for, sizes travel instead of
ids and positions.  Decoding takes rows of the token-byte table.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, slots

#: Folder of the public vocabulary files; a parameter of every function here.
FOLDER = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The pattern that cuts text into pre-tokens, a fixed part of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A block of documents ends when it holds so many characters or documents.
BLOCK_CHARS, BLOCK_DOCS = 2_000_000, 20_000
#: Blocks whose words are made distinct together; a word that all blocks have is no more rows than that in a task.
BLOCKS_PER_WORD = 4096
#: Encoded words a task gathers before it sends them to their blocks.
SEND_WORDS = 200_000

_BLOCK = "block bigint, kind int, payload binary"

#: Stands for a null doc_id in packed arrays.
_NO_DOC = np.iinfo(np.int64).min


class Vocabulary:
    """The ranks of a vocabulary file, the words that are themselves tokens, and the encoder of other words."""

    _kept: dict[int, Vocabulary] = {}

    def __init__(self, content: bytes) -> None:
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.words: dict[str, int] = {}
        for raw, rank in self.ranks.items():
            try:
                self.words[raw.decode()] = rank
            except UnicodeDecodeError:  # part of a character
                continue
        self.encoder = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def raw(self) -> pa.Array:
        """The bytes of each token by its id, null where there is none."""
        table: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            table[rank] = token
        return pa.array(table, pa.large_binary())

    @classmethod
    def of(cls, sent: Broadcast) -> Vocabulary:
        """The vocabulary of a broadcast file, built once per worker."""
        key = hash(sent.value)
        if key not in cls._kept:
            cls._kept[key] = cls(sent.value)
        return cls._kept[key]


def read_vocabulary(folder: str | None = None, name: str = VOCABULARY) -> bytes:
    """Content of a rank file (under 2 MB for the public ones)."""
    with open(os.path.join(folder or FOLDER, name), "rb") as f:
        return f.read()


class _Words(dict):
    """Codes of words: a token's id, or -1 - i for the i-th other word of the block."""

    def __init__(self, words: dict[str, int]) -> None:
        super().__init__(words)
        self.others: list[str] = []

    def __missing__(self, word: str) -> int:
        self.others.append(word)
        code = self[word] = -len(self.others)
        return code


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    parts = [a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(3).compress(struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts))


def _unpack(payload: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<q", raw)
    sizes = struct.unpack_from(f"<{n}q", raw, 8)
    out, at = [], 8 * (n + 1)
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _cut(sent: Broadcast, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find, vocabulary = regex.compile(PATTERN).findall, Vocabulary.of(sent)
        first = TaskContext.get().partitionId() << 32
        n_blocks = 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate([*codes, np.zeros(0, np.int32)])
            if whole:
                payload = _pack(np.array(ids, np.int64), np.array(counts, np.int32), flat)
            else:
                before = np.r_[0, np.cumsum(flat < 0)]
                ends = np.cumsum(np.array(counts, np.int64))
                others = before[ends] - before[ends - counts]
                payload = _pack(np.array(ids, np.int64), np.array(counts, np.int64) - others, others, -1 - flat[flat < 0])
            return pa.RecordBatch.from_arrays([pa.array([first + n_blocks]), pa.array([payload], pa.binary()), pa.array([words.others], pa.list_(pa.string()))], names=["block", "payload", "words"])

        ids, counts, codes, words, chars = [], [], [], _Words(vocabulary.words), 0
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                text = text.as_py()
                cut = find(text) if text else []
                ids.append(_NO_DOC if doc is None else doc)
                counts.append(len(cut))
                codes.append(np.fromiter(map(words.__getitem__, cut), np.int32, len(cut)))
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield close()
                    n_blocks += 1
                    ids, counts, codes, words, chars = [], [], [], _Words(vocabulary.words), 0
        if ids:
            yield close()

    return run


def _encode_words(sent: Broadcast, whole: bool):
    """Rows (block, at, word) sorted by word; gives for each block the ids of its words, or only how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Vocabulary.of(sent).encoder.encode_ordinary
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        n, last, last_ids = 0, None, []

        def send() -> pa.RecordBatch:
            block, at, size, starts = (np.concatenate(c) for c in list(zip(*held))[:4])
            ids = np.concatenate([h[4] for h in held])
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1], True])
            out_b, out_p = [], []
            for s, e in zip(cuts[:-1], cuts[1:]):
                pick = order[s:e]
                out_b.append(int(block[pick[0]]))
                out_p.append(_pack(at[pick], size[pick], ids[_spread(starts[pick], size[pick])]) if whole else _pack(at[pick], size[pick]))
            return pa.RecordBatch.from_arrays([pa.array(out_b), pa.array([0] * len(out_b), pa.int32()), pa.array(out_p, pa.binary())], names=["block", "kind", "payload"])

        base = 0
        for b in batches:
            coded = b["word"].dictionary_encode()
            lists = []
            for w in coded.dictionary.to_pylist():
                if w != last:
                    last, last_ids = w, encode(w)
                lists.append(last_ids)
            sizes = np.fromiter(map(len, lists), np.int32, len(lists))
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
            starts = np.r_[0, np.cumsum(sizes)[:-1]] + base
            pick = coded.indices.to_numpy()
            held.append((b["block"].to_numpy(), b["at"].to_numpy(), sizes[pick], starts[pick], flat))
            base += len(flat)
            n += b.num_rows
            if n >= SEND_WORDS:
                yield send()
                held, n, base = [], 0, 0
        if n:
            yield send()

    return run


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... (size of them) for each pair, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, kind): the ids of a block's words, then the block."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        for kind, payload in zip(b["kind"].to_pylist(), b["payload"]):
            if kind == 0:
                held.append(_unpack(payload.as_py(), np.int32, np.int32, np.int32))
                continue
            docs, counts, codes = _unpack(payload.as_py(), np.int64, np.int32, np.int32)
            at, size, ids = (np.concatenate([np.zeros(0, np.int32), *(h[i] for h in held)]) for i in range(3))
            held = []
            # the words' ids by place of the word in the block
            word_size, word_start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            word_size[at] = size
            word_start[at] = np.cumsum(size) - size
            other = codes < 0
            word = -1 - codes[other]
            sizes = np.ones(len(codes), np.int64)
            sizes[other] = word_size[word]
            ends = np.cumsum(sizes)
            flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
            begins = ends - sizes
            flat[begins[~other]] = codes[~other]
            flat[_spread(begins[other], word_size[word])] = ids[_spread(word_start[word], word_size[word])]
            offsets = np.r_[0, ends][np.r_[0, np.cumsum(counts, dtype=np.int64)]]
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == _NO_DOC), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])


def _assemble_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_assemble``, of blocks that hold per document the number of words that are tokens and the places of the others."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        for kind, payload in zip(b["kind"].to_pylist(), b["payload"]):
            if kind == 0:
                held.append(_unpack(payload.as_py(), np.int32, np.int32))
                continue
            docs, direct, n_others, others = _unpack(payload.as_py(), np.int64, np.int64, np.int64, np.int32)
            word_size = np.zeros(sum(len(h[0]) for h in held), np.int64)
            for at, size in held:
                word_size[at] = size
            held = []
            upto, ends = np.r_[0, np.cumsum(word_size[others])], np.cumsum(n_others)
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == _NO_DOC), pa.array(direct + upto[ends] - upto[ends - n_others])], names=["doc_id", "n_tokens"])


def _through_words(documents: DataFrame, sent: Broadcast, whole: bool) -> DataFrame:
    """(block, kind, payload) sorted by block and kind: a block's encoded words, then the block."""
    n = slots(documents.sparkSession)
    blocks = materialize(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_cut(sent, whole), "block bigint, payload binary, words array<string>"), "blocks")
    words = blocks.select("block", F.posexplode("words").alias("at", "word"))
    part = F.pmod(F.xxhash64("block"), F.lit(-(-blocks.count() // BLOCKS_PER_WORD) or 1))
    encoded = words.repartition(n, "word", part).sortWithinPartitions("word").mapInArrow(_encode_words(sent, whole), _BLOCK)
    parts = blocks.select("block", F.lit(1).alias("kind"), "payload").unionByName(encoded)
    return parts.repartition(n, "block").sortWithinPartitions("block", "kind")


def encode(documents: DataFrame, folder: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): each document's text as ids of the vocabulary, without special tokens.

    Strings of special tokens in a text are ordinary text.  A null and an empty text give an empty list.  Texts may be
    of any length and are encoded whole; repeated rows give a row each, a null doc_id stays null; no rows give none.
    """
    sent = documents.sparkSession.sparkContext.broadcast(read_vocabulary(folder, name))
    return _through_words(documents, sent, True).mapInArrow(_assemble, "doc_id bigint, ids array<int>")


def sizes(documents: DataFrame, folder: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): how many ids ``encode`` gives each document, without making the lists."""
    sent = documents.sparkSession.sparkContext.broadcast(read_vocabulary(folder, name))
    return _through_words(documents, sent, False).mapInArrow(_assemble_sizes, "doc_id bigint, n_tokens bigint")


def decode(encoded: DataFrame, folder: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) through the token-byte table, a broadcast of the vocabulary's fixed size.

    Bytes that are no valid UTF-8 (lists cut within a character) are read as U+FFFD; a null list gives null, an
    empty one an empty text; an id that the vocabulary lacks is an error.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = Vocabulary.of(sent).raw
        for b in batches:
            ids = b["ids"]
            flat = ids.flatten()
            if len(flat) and (pa.compute.max(flat).as_py() >= len(raw) or pa.compute.min(flat).as_py() < 0):
                raise ValueError("an id that the vocabulary lacks")
            taken = raw.take(flat)
            if taken.null_count:
                raise ValueError("an id that the vocabulary lacks")
            # the bytes of a batch lie one after the other; a text ends where its last token does
            ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
            lengths = pa.compute.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
            offsets = ends[np.r_[0, np.cumsum(lengths, dtype=np.int64)]]
            absent = ids.is_null()
            data = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), taken.buffers()[2]])
            try:
                texts = data.cast(pa.large_string())
            except pa.ArrowInvalid:
                texts = pa.array([x.decode("utf-8", "replace") for x in data.to_pylist()], pa.large_string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.compute.if_else(absent, None, texts).cast(pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
