import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from xgspark.llm import sharding


def walk(key, leaves):
    """The tree descended by hand."""
    def u(name):
        return (int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52

    node = ""
    for parent, child in ((lambda x: "", lambda x: x.region), (lambda x: x.region, lambda x: x.rack),
                          (lambda x: x.rack, lambda x: str(x.shard))):
        weights = Counter()
        for leaf in leaves:
            if parent(leaf) == node:
                weights[child(leaf)] += leaf.weight
        node = min((-math.log(u(c)) / w, c) for c, w in weights.items() if w > 0)[1]
    return int(node)


def shards_of(spark, leaves, n=3000):
    return [r.s for r in spark.range(n).orderBy("id").select(sharding.shard_of(F.col("id"), leaves).alias("s")).collect()]


def test_descent_equals_a_plain_walk(spark):
    leaves = sharding.layout(24)
    got = shards_of(spark, leaves, 500)
    assert got == [walk(str(i), leaves) for i in range(500)]
    assert set(shards_of(spark, leaves)) == set(range(24))


def test_weights_are_met(spark):
    leaves = [sharding.Leaf("g0", "k0", 0, 1.0), sharding.Leaf("g0", "k1", 1, 3.0), sharding.Leaf("g1", "k2", 2, 4.0)]
    n = 8000
    got = Counter(shards_of(spark, leaves, n))
    for leaf in leaves:
        p = leaf.weight / 8
        assert abs(got[leaf.shard] - n * p) < 5 * (n * p * (1 - p)) ** 0.5


def test_growth_moves_rows_only_into_the_new_shard(spark):
    leaves = sharding.layout(24)
    for _ in range(2):
        before, grown = shards_of(spark, leaves), sharding.grow(leaves)
        after = shards_of(spark, grown)
        moved = [(a, b) for a, b in zip(before, after) if a != b]
        assert moved and all(b == grown[-1].shard for _, b in moved)
        assert abs(len(moved) - 3000 / len(grown)) < 5 * (3000 / len(grown)) ** 0.5
        leaves = grown


def test_movement_stays_within_changed_subtrees(spark):
    """A heavier rack 1 of region g0: rows move only into or out of it, its
    siblings within g0, or its region; nothing moves inside another region."""
    leaves = sharding.layout(24)
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.rack == "k1" else 1.0) for x in leaves]
    where = {x.shard: x for x in leaves}
    for a, b in zip(shards_of(spark, leaves), shards_of(spark, heavy)):
        if a != b:
            assert where[b].rack == "k1" or where[b].region == "g0" != where[a].region
            assert where[a].rack != "k1"


def test_rows_sizes_and_slots(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    leaves = sharding.layout(24)
    got = sharding.place(odd_docs, leaves).collect()
    want = Counter()
    for r in rows:
        key, body = "" if r.doc_id is None else str(r.doc_id), (r.text or "").encode()
        want[(r.doc_id, len(body) + 8, zlib.crc32(body), walk(key, leaves), walk(key, sharding.grow(leaves)))] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.place(no_docs, leaves).count() == 0


def test_slots_over_many_ranges(spark):
    docs = spark.range(4000).select((F.col("id") % 1500).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.place(docs, sharding.layout(3)).groupBy("shard").agg(
        F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    assert all((r.n, r.lo) == (r.d, 0) and r.hi == r.n - 1 for r in got.collect())


def test_with_shard_refuses_a_taken_name(odd_docs):
    with pytest.raises(ValueError):
        sharding.with_shard(odd_docs, sharding.layout())
    assert sharding.with_shard(odd_docs, sharding.layout(), name="home").columns == [*odd_docs.columns, "home"]


def test_a_count_beyond_the_first_tree_has_one_layout():
    assert sharding.layout(25) == sharding.grow(sharding.layout(24))
    assert sharding.layout(27) == sharding.grow(sharding.grow(sharding.layout(25)))
    assert [x.shard for x in sharding.layout(30)] == list(range(30))
