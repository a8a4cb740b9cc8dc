import math
import random

import pytest

from xgspark.operators.metrics import cv_summary, fold_metrics, roc_auc


def _brute_auc(ps, ys):
    pos = [p for p, y in zip(ps, ys) if y == 1]
    neg = [p for p, y in zip(ps, ys) if y == 0]
    if not pos or not neg:
        return None
    s = 0.0
    for a in pos:
        for b in neg:
            s += 1.0 if a > b else 0.5 if a == b else 0.0
    return s / (len(pos) * len(neg))


def _fixture(seed=11, n=3000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        p = round(rnd.random(), 2)  # many ties
        y = 1 if rnd.random() < p else 0
        rows.append((i % 4, p, y))
    return rows


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_auc_matches_brute_force(spark, buckets):
    rows = _fixture()
    df = spark.createDataFrame(rows, "fold int, p double, is_goal int")
    got = {r.fold: r.roc_auc for r in roc_auc(df, "p", "is_goal", "fold", buckets=buckets).collect()}
    for f in range(4):
        ps = [p for g, p, _ in rows if g == f]
        ys = [y for g, _, y in rows if g == f]
        assert got[f] == pytest.approx(_brute_auc(ps, ys), abs=1e-12)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (0, 0.2, 0), (1, 0.3, 1), (1, 0.4, 0)],
                               "fold int, p double, is_goal int")
    got = {r.fold: r.roc_auc for r in roc_auc(df, "p", "is_goal", "fold").collect()}
    assert got[0] is None and got[1] == 0.0


def test_fold_metrics_and_summary(spark):
    rows = _fixture(seed=5, n=800)
    rows = [(f, min(max(p, 0.01), 0.99), y) for f, p, y in rows]
    df = spark.createDataFrame(rows, "fold int, p double, is_goal int")
    m = {r.fold: r for r in fold_metrics(df).collect()}
    per = {}
    for f in range(4):
        sub = [(p, y) for g, p, y in rows if g == f]
        ll = sum(-(y * math.log(p) + (1 - y) * math.log(1 - p)) for p, y in sub) / len(sub)
        br = sum((p - y) ** 2 for p, y in sub) / len(sub)
        per[f] = (ll, br)
        assert m[f].log_loss == pytest.approx(ll, rel=1e-12)
        assert m[f].brier == pytest.approx(br, rel=1e-12)
        assert m[f].n == len(sub)
    s = cv_summary(fold_metrics(df)).first()
    lls = [per[f][0] for f in range(4)]
    mean = sum(lls) / 4
    assert s.log_loss_mean == pytest.approx(mean)
    assert s.log_loss_std == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in lls) / 4))


def test_log_loss_clips_extremes(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (0, 0.0, 1)], "fold int, p double, is_goal int")
    r = fold_metrics(df).first()
    assert math.isfinite(r.log_loss) and r.log_loss > 30


def test_global_auc_without_group_key(spark):
    rows = [(0, p, y) for _, p, y in _fixture(seed=3, n=600)]
    df = spark.createDataFrame(rows, "fold int, p double, is_goal int")
    got = roc_auc(df, "p", "is_goal", None, buckets=4).first().roc_auc
    assert got == pytest.approx(_brute_auc([p for _, p, _ in rows], [y for _, _, y in rows]), abs=1e-12)
