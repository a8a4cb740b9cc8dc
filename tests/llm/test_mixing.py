import random
import re
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from xgspark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(sizes):
    """Targets by resharing until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: Fraction(left * weight[s], sum(weight[o] for o in open_)) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3 * sizes[s]) for s in order}
        full |= over


def make(spark, seed=1, lonely=True):
    rnd = random.Random(seed)
    rows = [(i, words(rnd, rnd.randrange(1, 60)), rnd.choice(["a", "b", "c", "d"])) for i in range(200)]
    rows += [(500 + i, words(rnd, 3), None) for i in range(4)] + [(600, None, "a"), (601, " ", "z"), (7, "x y", "a")] * 2
    if lonely:
        rows += [(700, "one two three", "B")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, words string")


def test_taken_words_meet_the_targets(spark):
    rows, docs = make(spark)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = goals(sizes)
    got = mixing.mix(docs).groupBy("doc_id", "row_key", "source_no", "copy", "size", "source_size", "target") \
        .agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken")).collect()
    assert len(got) == len(rows)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    for no, s in enumerate(order):
        mine = [r for r in got if r.source_no == no]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(float(want[s])) for r in mine)
        assert sum(r.taken for r in mine) == int(want[s] + Fraction(1, 2))
        assert all(r.taken <= 3 * r.size for r in mine)


def test_tree_splits_quotas_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 7)
    rows, docs = make(spark, 4)
    _, sources = mixing.streams(docs, doc_id="doc_id", text="text", source="source")
    quota = {r.source_no: -(-int(r.target + 0.5) // 40) for r in sources.collect()}
    blocks = mixing.block_shards(sources).collect()
    for no, q in quota.items():                  # every block once: disjoint draws, exact quotas
        assert sorted(r.block for r in blocks if r.source_no == no) == list(range(q))
    shards = -(-sum(quota.values()) // 7)
    loads = [sum(1 for r in blocks if r.shard == s) for s in range(shards)]
    assert max(loads) - min(loads) <= 1 and len({r.shard for r in blocks}) == shards > 10
    copies = mixing.mix(docs).filter("shard is not null")
    assert copies.agg(F.sum("words")).first()[0] == sum(int(r.target + 0.5) for r in sources.collect())
    again = mixing.mix(docs).filter("shard is not null")
    assert copies.exceptAll(again).count() == 0


def test_hypergeometric_inverts_the_distribution(spark):
    cases = [(30, 12, 9), (5, 5, 3), (5, 0, 3), (7, 3, 7), (7, 3, 0), (1, 1, 1), (0, 0, 0), (60, 25, 40)]
    us = [i / 50 + 0.01 for i in range(50)]
    df = spark.createDataFrame([(t, k, n, u) for t, k, n in cases for u in us], "t long, k long, n long, u double")
    rows = df.withColumn("x", mixing.hypergeometric(F.col("t"), F.col("k"), F.col("n"), F.col("u"))).collect()
    for r in rows:
        low, high = max(0, r.n - (r.t - r.k)), min(r.n, r.k)
        below = 0
        for x in range(low, high + 1):
            below += comb(r.k, x) * comb(r.t - r.k, r.n - x) / comb(r.t, r.n)
            if r.u < below:
                break
        assert r.x == x


def test_large_draws_stay_near_the_mean(spark):
    df = spark.range(200).select(((F.col("id") + 0.5) / 200).alias("u"))
    x = [r.x for r in df.select(mixing.hypergeometric(F.lit(3_000_000), F.lit(1_000_000), F.lit(1_500_000),
                                                      F.col("u")).alias("x")).collect()]
    sd = (1_500_000 / 3 * 2 / 3 / 2) ** 0.5
    assert abs(sum(x) / len(x) - 500_000) < sd and max(abs(v - 500_000) for v in x) < 5 * sd


def test_documents_of_the_mix(spark):
    rows, docs = make(spark, 2)
    got = mixing.mix_documents(docs, place=True)
    assert got.columns == [*docs.columns, "mix_shard", "mix_order"]
    taken = mixing.mix(docs).filter("shard is not null and 2 * words >= size").agg(F.count("*"), F.sum("size")).first()
    texts = [r.text for r in got.collect()]
    assert (len(texts), sum(len(WORD.findall(t)) for t in texts)) == tuple(taken)
    assert set(texts) <= {t for _, t, _ in rows}


def test_blocks_are_drawn_in_a_permuted_order(spark, monkeypatch):
    """The draws decide what is taken: with blocks in their own order other
    documents are; and no source's order of blocks is a rotation."""
    rows, docs = make(spark, 3)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)

    def taken():
        got = mixing.mix(docs).groupBy("row_key", "copy").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("w")).collect()
        return {(r.row_key, r.copy): r.w for r in got}

    permuted = taken()
    shards = {(r.source_no, r.block): r.shard for r in mixing.block_shards(
        mixing.streams(docs, doc_id="doc_id", text="text", source="source")[1]).collect()}
    monkeypatch.setattr(mixing, "drawn", lambda rows: rows)
    plain = taken()
    assert permuted.keys() == plain.keys() and sum(permuted.values()) == sum(plain.values()) and permuted != plain
    for quota in (2, 3, 7, 31, 331):
        blocks = spark.range(quota).select(F.lit(0).alias("source_no"), F.col("id").alias("block")) \
                      .withColumn("at", F.xxhash64(F.lit(mixing.SEED), "source_no", "block"))
        order = [r.block for r in mixing.position(blocks, "source_no", "at", "block").orderBy("position").collect()]
        assert sorted(order) == list(range(quota))
        steps = {(b - a) % quota for a, b in zip(order, order[1:])}
        assert quota < 4 or len(steps) > 1
    assert len(set(shards.values())) > 1 or len(shards) <= mixing.SHARD_BLOCKS


def test_one_id_and_text_under_two_sources_are_two_documents(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for _ in range(2):
        got = mixing.mix_documents(docs.repartition(3)).collect()
        assert {tuple(r) for r in got} == set(rows)


def test_odd_and_empty_tables(odd_docs, no_docs):
    got = mixing.mix(odd_docs)
    rows = got.groupBy("row_key", "copy", "size", "target").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken")).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == mixing.mix_documents(no_docs).count() == 0


def test_the_pipeline_mixes_whole_texts_nearest_the_target(spark):
    import corpus_pipeline

    rows, docs = make(spark, 5)
    long = [(900, "\n".join(["one two  three"] * 2000), "a"), (901, "x\ny " * 700, "long")]
    docs = docs.unionByName(spark.createDataFrame([(*r, "x") for r in long], docs.schema))
    docs = docs.withColumn("n_chars", F.length("text"))
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    whole = {(i, t, s) for i, t, s in rows + long}
    assert all((r.doc_id, r.text, r.source) in whole and r.n_chars == len(r.text) for r in got)
    placed, sources = mixing.streams(docs, doc_id="doc_id", text="text", source="source")
    of = {r.source_no: r.source for r in sources.collect()}
    size, goal, ends = {}, {}, {}
    for r in placed.collect():
        size[of[r.source_no]], goal[of[r.source_no]] = r.source_size, r.goal
        ends.setdefault(of[r.source_no], []).extend(r.start + r["size"] * (k + 1) for k in range(r.copies))
    for s, want in goal.items():
        words_ = sum(len(WORD.findall(r.text)) for r in got if r.source == s)
        every = [0, *(e + k * size[s] for e in ends[s] for k in range(mixing.MAX_EPOCHS))]
        assert abs(words_ - want) == min(abs(e - want) for e in every)
