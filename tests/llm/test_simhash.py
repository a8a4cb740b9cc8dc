import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from xgspark.llm import simhash
from xgspark.llm._components import components


def fingerprint_of(text):
    """Straight from the definition, bit by bit."""
    import xxhash

    w = (text or "").encode().lower().split()
    k = simhash.SHINGLE_WORDS
    grams = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprints_match_definition_and_spark_hash(spark):
    rnd = random.Random(2)
    texts = [None, "", "  ", "One", "a B c", "a b c d", words(rnd, 700), "Été ÉTÉ été x y", "x\x0by\tz\nq w"]
    got = simhash.fingerprints([(t or "").encode() for t in texts])
    assert [int(x) for x in got] == [fingerprint_of(t) for t in texts]
    h = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    import xxhash

    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("count", [10, 10_000_000])        # few and many buckets
def test_ball_hashing_links_equal_brute_force(spark, count):
    rnd = random.Random(5)
    prints = set()
    for _ in range(40):
        p = rnd.getrandbits(64)
        prints.add(p)
        for _ in range(rnd.randrange(4)):
            for b in rnd.sample(range(64), rnd.randrange(1, 7)):
                p ^= 1 << b
            prints.add(p)
    prints |= {0, 1, 3, 7, 15, 31, 0xFFFF}
    nodes = sorted(prints)
    want = groups_of([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4], nodes)
    signed = np.array(nodes, dtype=np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), count).collect()
    pairs = [(r.u % (1 << 64), r.v % (1 << 64)) for r in links]
    assert groups_of(pairs, nodes) == want
    assert all((a ^ b).bit_count() <= 64 for a, b in pairs)


def test_bucket_slices_do_not_change_links(monkeypatch):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(30)]
    prints = np.array(sorted({*base, *[b ^ 1 << rnd.randrange(64) for b in base]}), dtype=np.uint64)

    def links():
        return {tuple(x) for b in range(8) for x in zip(*simhash.bucket_links(prints, b, 3, 4))}

    whole = links()
    monkeypatch.setattr(simhash, "SLICE_VARIANTS", 500)
    nodes = prints.tolist()
    assert groups_of(links(), nodes) == groups_of(whole, nodes)


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] \
        + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(7, 7), (1, 0)]
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == groups_of(pairs, nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_groups_and_kept_documents(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = simhash.near_groups(odd_docs).collect()
    assert len(got) == len(rows)
    assert sorted(r.fp % (1 << 64) for r in got) == sorted(fingerprint_of(r.text) for r in rows)
    wordless = {r.component_id for r in got if r.fp == 0}
    assert wordless == {3}
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    prints = [fingerprint_of(r.text) for r in kept.collect()]
    assert len(prints) == len({r.root for r in got})
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert simhash.near_groups(no_docs).count() == simhash.drop_near_copies(no_docs).count() == 0


def test_near_copies_at_small_scale(spark):
    from tests.conftest import SF_SMALL
    from xgspark.sources.tables import read_table

    docs = read_table(spark, SF_SMALL, "documents")
    got = simhash.op6_simhash(spark, SF_SMALL).collect()
    prints = {r.doc_id: fingerprint_of(r.text) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(prints)
    want = groups_of([(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4], ids)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == \
        {i: (f"{prints[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_odd_distances_lose_no_pair(max_bits):
    rnd = random.Random(8)
    prints = {0, 1, 3, 7, 15, 31, 0xFFFF}
    for _ in range(12):
        p = rnd.getrandbits(64)
        near = rnd.sample(range(64), 9)            # crowded: many meet on one variant
        prints |= {p} | {p ^ sum(1 << b for b in rnd.sample(near, rnd.randrange(1, 6))) for _ in range(6)}
    nodes = sorted(prints)
    u, v = simhash.bucket_links(np.array(nodes, dtype=np.uint64), 0, 0, max_bits)
    pairs = [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= max_bits]
    assert groups_of(zip(u.tolist(), v.tolist()), nodes) == groups_of(pairs, nodes)
