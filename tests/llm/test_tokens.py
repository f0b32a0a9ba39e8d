import os

import pytest

from ledgerloom.llm import tokens as T
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(T.FOLDER, T.VOCABULARY)), reason="no vocabulary files here")

TEXTS = [
    None,
    "",
    " ",
    "\n\n\n",
    "Hello world, it's 2027!",
    "<|endoftext|> is text <|endoftext|>",
    "naïve café — “quotes” … 日本語のテキスト हिन्दी текст 🙂🙂‍👩‍👧",
    "\x00\x1c\x1d\x85  　﻿ mixed\twhite  space \r\n",
    "a" * 3000,
    "0a1b2c" * 500,
    " " * 5000 + "x",
    "�� broken Ã©",
    "ͷ ⅷ ² ٣ ᛮ 𝟘 \U0001e900",
]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(T.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("size", [T.BLOCK_CHARS, 40])
def test_ids_as_the_tokenizer(spark, monkeypatch, size):
    monkeypatch.setattr(T, "BLOCK_CHARS", size)
    monkeypatch.setattr(T, "SEND_WORDS", 7)
    monkeypatch.setattr(T, "BLOCKS_PER_WORD", 2)
    texts = TEXTS + TEXTS[3:]
    df = spark.createDataFrame([(i, "x", x, [1]) for i, x in enumerate(texts)], "doc_id bigint, block string, text string, ids array<int>")
    encoded = T.encode(df).cache()
    assert dict(rows(encoded, "doc_id", "ids")) == dict(enumerate(reference(texts)))
    assert dict(rows(T.decode(encoded))) == {i: x or "" for i, x in enumerate(texts)}
    assert dict(rows(T.sizes(df))) == {i: len(x) for i, x in enumerate(reference(texts))}


def test_decoding_broken_and_absent_lists(spark):
    word = reference(["日本"])[0]
    df = spark.createDataFrame([(1, word[:-1]), (2, None), (3, []), (4, word + word), (None, word)], "doc_id bigint, ids array<int>").coalesce(1)
    got = dict(rows(T.decode(df), "doc_id", "text"))
    assert "\ufffd" in got.pop(1)
    assert got == {2: None, 3: "", 4: "日本日本", None: "日本"}
    with pytest.raises(Exception, match="vocabulary lacks"):
        T.decode(spark.createDataFrame([(1, [10**6])], "doc_id bigint, ids array<int>")).collect()


def test_empty_table(spark):
    assert rows(T.encode(spark.createDataFrame([], "doc_id bigint, text string"))) == []
    assert rows(T.sizes(spark.createDataFrame([], "doc_id bigint, text string"))) == []
    assert rows(T.decode(spark.createDataFrame([], "doc_id bigint, ids array<int>"))) == []


def test_repeated_rows_give_a_row_each(spark):
    df = spark.createDataFrame([(1, "same text")] * 3 + [(None, "same"), (None, None)], "doc_id bigint, text string")
    assert sorted(((d, len(i)) for d, i in rows(T.encode(df), "doc_id", "ids")), key=str) == [(1, 2)] * 3 + [(None, 0), (None, 1)]
    assert rows(T.sizes(df)) == [(1, 2)] * 3 + [(None, 0), (None, 1)]
