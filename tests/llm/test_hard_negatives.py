import math
import random

import pytest

from tests.conftest import SF_SMALL
from xgspark.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>, score string, block int, id long"


def brute(rows, step=50, positives=5, negatives=3):
    base = []
    for i, label, v, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        base.append((i, label, [math.floor(256 * x) for x in v]))

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    def order(x):
        return -x[0], (x[1] is None, x[1])

    out = []
    for n, (i, label, v) in enumerate(base):
        if i is None or i % step:
            continue
        scored = [(dot(v, w), j, same) for m, (j, same, w) in enumerate(base) if m != n]
        pos = sorted((x for x in scored if x[2] == label), key=order)[:positives]
        neg = sorted((x for x in scored if x[2] != label), key=order)
        for ps, p, _ in pos:
            inside = [x for x in neg if 50 * ps <= 100 * x[0] <= 95 * ps][:negatives]
            out += [(i, p, r + 1, x[1], ps, x[0]) for r, x in enumerate(inside)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 7) for r in rows], SCHEMA)


def got(df, **options):
    return sorted((tuple(r) for r in H.hard_negatives(df, **options).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(rnd, n, dims=6, spread=0.4):
    centre = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(3)]
    return [(i, rnd.randrange(3), [c + rnd.gauss(0, spread) for c in centre[rnd.randrange(3)]]) for i in range(n)]


@pytest.mark.parametrize("chunk,block,group", [(8192, 256, 16), (7, 2, 1)])
def test_equals_brute_force(spark, monkeypatch, chunk, block, group):
    monkeypatch.setattr(H, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(H, "GROUP_BLOCKS", group)
    rows = vectors(random.Random(5), 120)
    want = brute(rows, step=5)
    assert len(want) > 100
    assert got(table(spark, rows).repartition(5), step=5) == want


def test_ties_repeats_nulls_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK_ROWS", 16)
    rnd = random.Random(8)
    rows = [(i, rnd.randrange(2), [rnd.choice((0.5, 1.0)), rnd.choice((0.25, 1.0))]) for i in range(60)]   # many ties
    rows += [rows[10], rows[10], rows[20], rows[7]]                                   # repeated rows, anchors too
    rows += [(None, 0, [1.0, 1.0]), (None, 1, [0.7, 0.7]), (100, None, [1.0, 1.0]), (110, 0, None), (120, 1, [1.0, None]),
             (130, 0, [float("nan"), 1.0]), (140, 0, [float("inf"), 0.0]), (150, 1, []), (160, 0, [0.6]),
             (170, 1, [-1.0, 0.5]), (180, 0, [0.0, 0.0]), (-10, 1, [0.9, 0.9, 3.0]), (200, 0, [-0.001, -1.0])]
    rows += [(300 + i, 0, [1.0, 1.0]) for i in range(40)] + [(400 + i, 1, [0.9, 0.9]) for i in range(40)]  # a hot vector
    assert got(table(spark, rows), step=10) == brute(rows, step=10)


def test_products_beyond_doubles_are_exact(spark):
    rnd = random.Random(2)
    big = [(i, rnd.randrange(2), [rnd.uniform(1, 3) * 1e5, rnd.uniform(1, 2) * 1e5]) for i in range(40)]
    assert max(abs(r[4]) for r in brute(big, step=4)) > 2 ** 53 / 4
    assert got(table(spark, big), step=4) == brute(big, step=4)
    huge = [(i, rnd.randrange(2), [rnd.uniform(1, 3) * 1e6, 1e6]) for i in range(30)]
    assert len(brute(huge, step=3)) > 10
    assert got(table(spark, huge), step=3) == brute(huge, step=3)


def test_shares_round_like_whole_numbers(spark):
    values = [0, 1, -1, 19, 20, 21, 99, 100, 101, -99, -100, -101, 10 ** 15 + 7, -(10 ** 15) - 7, (1 << 63) - 1, 1 - (1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "score long")
    for r in df.select("score", H._share("score", 95, False).alias("u"), H._share("score", 50, True).alias("l")).collect():
        assert r.u == 95 * r.score // 100 and r.l == -(-50 * r.score // 100)


def test_empty_tables(spark):
    assert got(table(spark, [])) == []
    assert got(table(spark, [(1, 0, [1.0])])) == []
    assert got(table(spark, [(50, 0, [1.0])])) == []
    assert got(table(spark, [(50, None, None)])) == []
    assert got(table(spark, [(50, 0, [1.0]), (51, 0, [1.0])])) == []


def test_query_on_the_whole_table(spark):
    from xgspark.sources.tables import read_table

    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in read_table(spark, SF_SMALL, "embeddings").collect()]
    out = sorted((tuple(r) for r in H.op11_hard_negatives(spark, SF_SMALL).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)
    assert out == brute(rows) and out
