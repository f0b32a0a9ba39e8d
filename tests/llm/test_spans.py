import itertools
import random

import pytest

from ledgerloom.llm import spans as S
from tests.conftest import rows

LEAST = 200


def brute_pairs(texts):
    grams = {}
    for doc, text in texts:
        if text:
            for i in range(len(text) - LEAST + 1):
                grams.setdefault(text[i : i + LEAST], set()).add(doc)
    return {p for docs in grams.values() for p in itertools.combinations(sorted(docs), 2)}, grams


def brute_coverage(texts, grams):
    out = {}
    for doc, text in texts:
        text = text or ""
        hit = [False] * len(text)
        for i in range(len(text) - LEAST + 1):
            if len(grams[text[i : i + LEAST]]) > 1:
                hit[i : i + LEAST] = [True] * LEAST
        out[doc] = (len(text), sum(hit))
    return out


def corpus():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh \n日🙂") for _ in range(n))
    shared = [word(n) for n in (199, 200, 201, 350, 900)]
    texts = [word(rng.randrange(0, 400)) for _ in range(25)]
    for i, s in enumerate(shared * 2):
        texts += [word(rng.randrange(0, 80)) + s + word(rng.randrange(0, 80))]
        if i % 3 == 0:
            texts += [s + s[:150]]
    whole = word(450)
    texts += [whole, whole, whole, whole + "x", word(30) + whole]
    texts += [" " * 700, " " * 450, "x" + " " * 230, " " * 199, "ab" * 300, "zz" + "ab" * 120, "ab" * 99 + "a", "ba" * 150]
    period = word(130)
    texts += [period * 4, word(20) + period * 3, period[:70] + period * 2]
    texts += [None, "", "short", None, whole[:199]]
    return list(enumerate(texts))


@pytest.mark.parametrize("pairwise, chunk", [(S.PAIRWISE, S.CHUNK), (3, 2), (0, 4)])
def test_pairs_and_coverage(spark, monkeypatch, pairwise, chunk):
    # with less than a group's members its windows are hashed, with 0 those of every group
    monkeypatch.setattr(S, "PAIRWISE", pairwise)
    monkeypatch.setattr(S, "CHUNK", chunk)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "doc_id bigint, text string, digest string, at int").repartition(5)
    pairs, grams = brute_pairs(texts)
    assert rows(S.sharing_pairs(df)) == sorted(pairs, key=str)
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in S.coverage(df).collect()}
    assert got == brute_coverage(texts, grams)
    assert removed_chars(S.removed_spans(df)) == brute_removed(texts, grams)


def removed_chars(df):
    return {(r["doc_id"], i) for r in df.collect() for i in range(r["start"], r["end"])}


def brute_removed(texts, grams):
    return {(doc, i + k) for doc, text in texts for i in range(len(text or "") - LEAST + 1) if min(grams[text[i : i + LEAST]]) < doc for k in range(LEAST)}


def test_footers_of_all_documents(spark, monkeypatch):
    # a footer that is too short to be shared makes no pair; a longer one that half the documents have makes all of theirs
    monkeypatch.setattr(S, "PAIRWISE", 8)
    monkeypatch.setattr(S, "CHUNK", 16)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long_ = word(180), word(260)
    texts = [(i, word(rng.randrange(120)) + (long_ if i % 2 else short) + word(i % 3 * 30)) for i in range(90)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    pairs, grams = brute_pairs(texts)
    assert rows(S.sharing_pairs(df)) == sorted(pairs, key=str)
    assert {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in S.coverage(df).collect()} == brute_coverage(texts, grams)


def test_window_digests_tell_stretches_apart():
    import numpy as np

    points = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 0, 0, 0, 0, 0, 0, 0], np.uint32)
    for length in (1, 3, 5, 8, 13):
        high, low = S.window_digests(points, length)
        stretches = [tuple(points[i : i + length]) for i in range(len(points) - length + 1)]
        assert len(high) == len(stretches) == len(low)
        assert len(set(zip(high, low))) == len(set(high)) == len(set(low)) == len(set(stretches))


def test_removed_keeps_the_earliest(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(3, "xx" + text), (1, text + "yy"), (2, text + "yy"), (4, "other")], "doc_id bigint, text string")
    assert rows(S.removed_spans(df)) == [(2, 0, 302), (3, 2, 302)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert rows(S.sharing_pairs(df)) == []
    assert rows(S.coverage(df)) == []
    assert rows(S.repeated_units(df)) == []


def test_rows_without_an_id_and_repeated_rows(spark):
    text = "".join(random.Random(1).choice("abc") for _ in range(250))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "x" + text), (None, None)], "doc_id bigint, text string")
    assert rows(S.sharing_pairs(df)) == [(1, 2)]
    assert rows(S.coverage(df))[0] == (1, 250, 250)


def test_repeated_lines(spark):
    a, b = "The quick brown fox jumps over the lazy dog again", "Another line that is long enough to be counted here"
    df = spark.createDataFrame([(2, f"{a}\n\nx\n{b}"), (1, f"start\r\n  {a.upper()}  \n"), (3, None), (4, f"{b}\n{b}")], "doc_id bigint, text string")
    got = rows(S.repeated_units(df))
    assert got == sorted([(2, 0, len(a), 1, 7), (4, 0, len(b), 2, len(a) + 4), (4, len(b) + 1, len(b), 2, len(a) + 4)], key=str)


def test_spans_merge(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 3, 4), (1, 9, 12), (2, 1, 2), (2, 1, 4)], "doc_id bigint, start bigint, end bigint")
    assert rows(S.merge_spans(df)) == [(1, 0, 7), (1, 9, 12), (2, 1, 4)]
