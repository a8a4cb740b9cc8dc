import random

import pytest
from pyspark.sql import functions as F

from xgspark.operators.folds import (
    FoldError, assert_no_leakage, effective_folds, fold_map, fold_sizes, group_kfold,
    run_segments,
)


def _reference_greedy(counts: dict, k: int) -> dict:
    order = sorted(counts.items(), key=lambda kv: (-kv[1], -kv[0]))
    loads = [0] * k
    out = {}
    for g, n in order:
        f = loads.index(min(loads))
        loads[f] += n
        out[g] = f
    return out


def _rows(seed=7, groups=60):
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        for _ in range(rnd.randint(1, 40)):
            rows.append((g,))
    # one hot group with about a third of all rows
    rows += [(999,)] * (len(rows) // 2)
    return rows


def test_greedy_matches_reference(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "match_id long")
    got = {r.match_id: r.fold for r in fold_map(df, "match_id", 5).collect()}
    counts = {}
    for (g,) in rows:
        counts[g] = counts.get(g, 0) + 1
    assert got == _reference_greedy(counts, 5)


@pytest.mark.parametrize("method", ["greedy", "hash"])
def test_whole_groups_and_balance(spark, method):
    rows = _rows(seed=3)
    df = spark.createDataFrame(rows, "match_id long")
    folded = group_kfold(df, "match_id", 5, method)
    assert folded.count() == len(rows)
    leak = assert_no_leakage(folded).first()
    assert leak.n_leaking_groups == 0 and leak.n_groups == 61
    sizes = fold_sizes(folded).collect()
    assert sum(r.test_rows for r in sizes) == len(rows)
    assert all(r.train_rows + r.test_rows == len(rows) for r in sizes)
    if method == "greedy":
        largest = max(r["n"] for r in fold_map(df, "match_id").collect())
        spread = max(r.test_rows for r in sizes) - min(r.test_rows for r in sizes)
        assert spread <= largest


def _one_by_one(loads, n, count):
    loads, out = list(loads), []
    for _ in range(count):
        f = loads.index(min(loads))
        loads[f] += n
        out.append(f)
    return loads, out


def test_run_segments_equal_one_by_one():
    rnd = random.Random(11)
    for _ in range(1500):
        k = rnd.randint(2, 7)
        loads = [rnd.randrange(rnd.choice([2, 50])) + 400 * (rnd.random() < 0.1) for _ in range(k)]
        n, count = rnd.randint(1, 9), rnd.randrange(70)
        walked = list(loads)
        segments = run_segments(walked, n, count)
        assert len(segments) <= k
        got = []
        for rank in range(count):
            start, folds = [x for x in segments if x[0] <= rank][-1]
            got.append(folds[(rank - start) % len(folds)])
        assert (walked, got) == _one_by_one(loads, n, count)


@pytest.mark.parametrize("shape", ["random", "one size", "hot"])
def test_greedy_over_several_ranges(spark, monkeypatch, shape):
    """The same folds when groups are ranked in many ranges as one by one."""
    import xgspark.operators.folds as folds_mod

    monkeypatch.setattr(folds_mod, "GROUPS_PER_RANGE", 25)
    if shape == "random":
        rnd = random.Random(5)
        counts = {g: rnd.randint(1, 9) for g in range(300)}
    else:
        counts = {g: 3 for g in range(300)}
    if shape == "hot":
        counts[1000] = 450
    df = spark.createDataFrame([(g,) for g, n in counts.items() for _ in range(n)], "match_id long")
    got = {r.match_id: (r.n, r.fold) for r in fold_map(df, "match_id", 5).collect()}
    want = _reference_greedy(counts, 5)
    assert got == {g: (n, want[g]) for g, n in counts.items()}


def test_effective_folds():
    assert effective_folds(100) == 5
    assert effective_folds(3) == 3
    with pytest.raises(FoldError):
        effective_folds(1)


def test_fewer_groups_than_folds_reduces_k(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (3,)], "match_id long")
    folded = group_kfold(df, "match_id", 5)
    assert sorted(r.fold for r in folded.select("fold").distinct().collect()) == [0, 1, 2]
    with pytest.raises(FoldError):
        group_kfold(spark.createDataFrame([(1,), (1,)], "match_id long"), "match_id", 5)
