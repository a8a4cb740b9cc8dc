import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.conftest import words
from xgspark.llm import quality
from xgspark.sources.tables import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_base_counts_equal_brute_force(spark, odd_docs):
    extra = ["a b a b a b", "x\nx\n x\nx", "  \n  \n", "#a *b\n$|<> &&", "a b c " * 30, "é ü\x0bß\x0cç", words(__import__("random").Random(1), 300, 12)]
    docs = odd_docs.select("text").unionByName(spark.createDataFrame([(t,) for t in extra], "text string"))
    got = docs.select("text", quality.measures(F.col("text"), F.lit(False), np.zeros((2, quality.BUCKETS)), spark).alias("m")).collect()
    for r in got:
        m = r.m
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == base(r.text)[:5]


def test_scores_equal_a_plain_model(spark):
    """The ratio from counts kept in a dict, counted anew without the document."""
    docs = [(0, "a b c a"), (1, "a b x, été"), (2, "z z z q"), (3, None), (4, ""), (5, "ab"), (0, "a b c a"), (6, "abc" * 500)]
    labels = [(0, 1, 0), (1, 1, 0), (2, 0, 0), (9, 1, 0), (None, 1, 0), (1, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id, r.quality.score) for r in quality.score(d, lab).collect())

    def grams(t):
        raw = (t or "").encode()
        return [raw[i:i + 3] for i in range(len(raw) - 2)]

    want = []
    for n, (i, t) in enumerate(docs):
        raw, target = Counter(), Counter()
        for m, (j, u) in enumerate(docs):
            if m != n:
                raw.update(grams(u))
                if j in (0, 1):
                    target.update(grams(u))
        s = []
        for g in grams(t):
            r = (raw[g] + 0.5) / (sum(raw.values()) + 0.5 * quality.BUCKETS)
            s.append(np.log(0.995 * target[g] / sum(target.values()) / r + 0.005))
        want.append((i, sum(s) / len(s) if s else 0.0))
    want.sort()
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, want))


def test_documents_are_judged_alike_whether_their_label_was_used_or_not(spark):
    """Labels halved by a hash of the id: what is withheld is judged like what
    was used, in every language; no labelled bad document passes either way."""
    docs = read_table(spark, SF_MID, "documents")
    labels = read_table(spark, SF_MID, "labels")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    rows = (quality.score(docs.drop("quality"), labels.filter(half == 0))
            .withColumn("used", half == 0).withColumnRenamed("quality", "q").join(labels, "doc_id").collect())
    for used in (True, False):
        of = [r for r in rows if r.used == used and not r.q.base_failed]
        bad = [r.q.kept for r in of if r.quality == 0]
        assert len(bad) > 5 and sum(bad) <= 0.1 * len(bad)
        for lang in ("en", "de", "fr", "es"):
            good = [r.q.kept for r in of if r.lang == lang and (r.quality, r.toxic) == (1, 0)]
            assert len(good) > 5 and sum(good) >= 0.9 * len(good), (used, lang)


def test_good_documents_are_kept_and_bad_ones_not(spark):
    rows = quality.op10_quality(spark, SF_MID).join(read_table(spark, SF_MID, "labels"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) > 100
    assert sum(r.kept for r in bad) <= 0.05 * len(bad)
    assert not any(r.kept and r.base_failed for r in rows)


def test_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(odd_docs, none)
    assert got.columns == [*odd_docs.columns, "quality_"]
    assert all(r.quality_.score == 0.0 and r.quality_.kept != r.quality_.base_failed for r in got.collect())
    assert quality.score(no_docs, none).count() == 0


def test_every_label_counts_and_toxic_ids_are_not_trusted(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(labels).count() == 30_000
    both = labels.limit(3).unionByName(labels.limit(1).withColumn("toxic", F.lit(1)))
    assert quality.trusted_ids(both).count() == 2


def test_a_single_trusted_document_says_nothing_about_itself(spark):
    d = spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality.score for r in quality.score(d, lab).collect()}
    assert got[1] == 0.0 and got[2] != 0.0
