"""Suffix-array and automaton dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import words
from xgspark.llm import _repeats, phrase_dedup, suffix_dedup


def brute(texts, size):
    """Kept mask of every sequence: windows that start in two places go."""
    seen = Counter(t[a:a + size] for t in texts for a in range(len(t) - size + 1))
    out = []
    for t in texts:
        keep = [True] * len(t)
        for a in range(len(t) - size + 1):
            if seen[t[a:a + size]] > 1:
                keep[a:a + size] = [False] * size
        out.append(keep)
    return out


def runs(keep):
    return sum(1 for i, k in enumerate(keep) if not k and (i == 0 or keep[i - 1]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=5))
def test_grouping_construction_equals_sorting(blocks):
    got = suffix_dedup.suffix_arrays([np.array(b, dtype=np.int64) for b in blocks])
    for b, order in zip(blocks, got):
        assert list(order) == sorted(range(len(b)), key=lambda i: b[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4), st.integers(0, 2))
def test_segments_cover_every_window_once(texts, extra):
    size, k = 8 + extra, 3
    codes, first = _repeats.Bytes.codes([t.encode() for t in texts])
    d, lo, n, h, s = _repeats.segments(codes, first, size, k)
    got = sorted((a, b + j) for a, b, c in zip(d, lo, n) for j in range(c))
    assert got == [(i, j) for i, t in enumerate(texts) for j in range(len(t) - size + 1)]
    # equal windows have equal anchors
    where = {}
    for a, b, c, x in zip(d, lo, n, h):
        for j in range(c):
            assert where.setdefault(texts[a][b + j:b + j + size], x) == x


def corpus(spark, seed=3):
    rnd = random.Random(seed)
    passage, other = words(rnd, 80), words(rnd, 45)
    rows = [(i, words(rnd, rnd.randrange(0, 90))) for i in range(40)]
    rows += [(100 + i, f"{words(rnd, 9)} {passage} {words(rnd, 7)}") for i in range(12)]
    rows += [(200 + i, f"{other}\n{words(rnd, 20)} é{i} {other}") for i in range(3)]
    rows += [(300, "ab" * 400), (301, "x " * 120), (302, passage), (302, passage), (303, None), (304, ""), (305, " \n")]
    return rows, spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows],
                                       "doc_id long, text string, runs string, packed string")


def check_bytes(rows, got):
    raw = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, keep in zip(rows, raw, brute(raw, suffix_dedup.MATCH_BYTES)):
        kept = bytes(b for b, k in zip(t, keep) if k)
        want.append((i, len(t), keep.count(False), runs(keep), hashlib.sha256(kept).hexdigest()))
    rows = got.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]),
                      F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(tuple(r) for r in rows) == sorted(want)
    return sum(w[2] for w in want)


def check_words(rows, got):
    raw = [tuple((t or "").encode().split()) for _, t in rows]
    want = []
    for (i, _), t, keep in zip(rows, raw, brute(raw, phrase_dedup.WINDOW_WORDS)):
        kept = b" ".join(w for w, k in zip(t, keep) if k)
        want.append((i, len(t), keep.count(False), hashlib.sha256(kept).hexdigest()))
    rows = got.select("doc_id", "n_words", F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]),
                      F.sha2("kept", 256)).collect()
    assert sorted(tuple(r) for r in rows) == sorted(want)
    return sum(w[2] for w in want)


@pytest.mark.parametrize("crowd", [64, 1])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(_repeats, "GROUP_SEGMENTS", crowd)
    rows, docs = corpus(spark)
    assert check_bytes(rows, suffix_dedup.strip_repeats(docs)) > 5000


@pytest.mark.parametrize("crowd", [64, 1])
def test_phrase_dedup_equals_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(_repeats, "GROUP_SEGMENTS", crowd)
    rows, docs = corpus(spark)
    assert check_words(rows, phrase_dedup.strip_phrases(docs)) > 900


def test_very_long_texts_are_cut_for_the_search_only(spark, monkeypatch):
    monkeypatch.setattr(_repeats, "PIECE_UNITS", 350)
    monkeypatch.setattr(_repeats, "BATCH_BYTES", 700)
    rows, docs = corpus(spark, seed=8)
    check_bytes(rows, suffix_dedup.strip_repeats(docs))
    check_words(rows, phrase_dedup.strip_phrases(docs))


def test_odd_and_empty_tables(odd_docs, no_docs):
    rows = [(r.doc_id if r.doc_id is not None else -1, r.text) for r in odd_docs.collect()]
    filled = odd_docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    check_bytes(rows, suffix_dedup.strip_repeats(filled))
    check_words(rows, phrase_dedup.strip_phrases(filled))
    assert suffix_dedup.strip_repeats(odd_docs).count() == phrase_dedup.strip_phrases(odd_docs).count() == len(rows)
    assert suffix_dedup.strip_repeats(no_docs).count() == phrase_dedup.strip_phrases(no_docs).count() == 0


def test_automaton_finds_passages_of_other_stretches():
    a = "s1 " + " ".join(f"p{i}" for i in range(40)) + " e1"
    b = "s2 " + " ".join(f"p{i}" for i in range(36)) + " e2"
    h = np.zeros(2, dtype=np.int64)
    got = phrase_dedup.resolve(h, np.arange(2), np.ones(2, dtype=np.int64), [a.encode(), b.encode()])
    assert [set(zip(r[0::2], r[1::2])) for r in got] == [{(1, 37)}, {(1, 37)}]
