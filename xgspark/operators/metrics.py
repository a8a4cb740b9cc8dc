"""Evaluation metrics as grouped aggregates (M1-M4, A5).

All metrics are computed per ``by`` key (the fold) in one distributed pass
each; nothing is collected.  Exact ROC-AUC (ties count one half) needs the
number of negatives scored below each positive: scores are first reduced to
distinct ``(by, score)`` rows (so a hot score is one row), then prefix sums
run per score *range bucket* with bucket offsets from a small table, so no
task ever holds all scores of a fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xgspark.config import LOG_LOSS_EPS
from xgspark.operators.joins import broadcast_if_small
from xgspark.session import materialize_counted

# Score buckets for the distributed prefix sum of the AUC: about this many
# distinct scores per bucket, between the two bounds below.
AUC_ROWS_PER_BUCKET = 1_000_000
AUC_MAX_BUCKETS = 16_384


def _by_cols(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def log_loss_term(p: Column, y: Column, eps: float = LOG_LOSS_EPS) -> Column:
    """Per-row log loss with ``p`` clipped to ``[eps, 1 - eps]`` (M1)."""
    pc = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    yd = y.cast("double")
    return -(yd * F.ln(pc) + (F.lit(1.0) - yd) * F.ln(F.lit(1.0) - pc))


def brier_term(p: Column, y: Column) -> Column:
    """Per-row squared error (M2)."""
    d = p - y.cast("double")
    return d * d


def score_counts(df: DataFrame, p: str = "p", y: str = "is_goal",
                 by: str | Sequence[str] | None = None) -> DataFrame:
    """Distinct scores per group with positive / negative counts.

    Partial-aggregated before the shuffle; a hot score (or a hot group) is
    one row here, whatever its row count.
    """
    keys = _by_cols(by)
    yd = F.col(y).cast("long")
    return (df.groupBy(*keys, F.col(p).alias("__p"))
              .agg(F.sum(yd).alias("__pos"), F.sum(F.lit(1) - yd).alias("__neg")))


def auc_buckets(n_scores: int) -> int:
    """Bucket count for ``n_scores`` distinct scores: about a million per
    bucket.  Up to a million scores one bucket (per group) is already a
    bounded window task, and no quantile pass is needed."""
    want = -(-n_scores // AUC_ROWS_PER_BUCKET)
    return int(min(max(want, 1), AUC_MAX_BUCKETS))


def _auc_from_counts(scores: DataFrame, keys: list[str], buckets: int | None,
                     n_scores: int | None = None) -> DataFrame:
    from pyspark.ml.feature import Bucketizer

    if buckets is None:
        buckets = auc_buckets(scores.count() if n_scores is None else n_scores)
    # Quantile split points over the distinct scores (all groups together):
    # one small distributed aggregate; only the split points reach the driver.
    qs = [i / buckets for i in range(1, buckets)]
    splits_row = scores.agg(F.percentile_approx("__p", qs, max(10_000, 10 * buckets)).alias("s")).first() \
        if qs else None
    inner = sorted({float(v) for v in ((splits_row["s"] if splits_row else None) or [])
                    if v is not None and v == v and abs(v) != float("inf")})
    # Bucketizer: binary search in the JVM; buckets are [s_i, s_i+1), monotone
    # in the score, so equal scores always share a bucket.
    if inner:
        splits = [float("-inf"), *inner, float("inf")]
        scores = Bucketizer(splits=splits, inputCol="__p", outputCol="__bd", handleInvalid="keep") \
            .transform(scores).withColumn("__b", F.col("__bd").cast("int")).drop("__bd")
    else:
        scores = scores.withColumn("__b", F.lit(0))
    per_bucket = scores.groupBy(*keys, "__b").agg(F.sum("__neg").alias("__bneg"))
    w_off = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))) \
        .orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # groups x buckets rows; broadcast only behind a count of them.
    offsets = per_bucket.select(*keys, "__b", F.coalesce(F.sum("__bneg").over(w_off), F.lit(0)).alias("__off"))
    w_in = Window.partitionBy(*keys, "__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = scores.withColumn("__below_in", F.coalesce(F.sum("__neg").over(w_in), F.lit(0)))
    joined = ranked.join(broadcast_if_small(offsets), [*keys, "__b"], "inner")
    below = F.col("__off") + F.col("__below_in")
    pos_total = F.sum("__pos")
    neg_total = F.sum("__neg")
    credit = F.sum(F.col("__pos").cast("double") * (below.cast("double") + F.col("__neg").cast("double") / 2.0))
    auc = F.when((pos_total > 0) & (neg_total > 0),
                 credit / (pos_total.cast("double") * neg_total.cast("double")))
    grouped = joined.groupBy(*keys) if keys else joined.groupBy()
    return grouped.agg(auc.alias("roc_auc"))


def roc_auc(df: DataFrame, p: str = "p", y: str = "is_goal",
            by: str | Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC per ``by`` group; ties count one half (M4).

    ``AUC = sum_pos(neg_below + neg_equal / 2) / (P * N)``; NULL when a group
    has no positive or no negative.  Steps:

    1. distinct scores: ``groupBy(by, p)`` -> ``pos, neg`` (partial agg);
    2. score range buckets from approximate quantiles of the distinct scores
       (the quantiles only balance the buckets; the result is exact); the
       bucket count grows with the number of distinct scores
       (:func:`auc_buckets`), so a bucket stays near a million rows;
    3. negatives below each score = bucket offset (window over the small
       per-bucket table) + prefix sum inside the bucket (window per bucket),
       so no task holds all scores of a group.
    """
    keys = _by_cols(by)
    sc, n = materialize_counted(score_counts(df, p, y, keys), "score-counts")
    return _auc_from_counts(sc, keys, buckets, n)


def fold_metrics(scored: DataFrame, p: str = "p", y: str = "is_goal",
                 by: str | Sequence[str] = "fold", buckets: int | None = None) -> DataFrame:
    """Per group: ``n, goals, log_loss, roc_auc, brier`` (M1-M3).

    Every metric comes from the one distinct-score aggregate: log loss and
    Brier are count-weighted sums over distinct scores, so the rows are
    scanned and shuffled once.
    """
    keys = _by_cols(by)
    # One pass over the rows; everything after reads the distinct-score table.
    sc, n_scores = materialize_counted(score_counts(scored, p, y, keys), "score-counts")
    pc, pos, neg = F.col("__p"), F.col("__pos").cast("double"), F.col("__neg").cast("double")
    one, zero = F.lit(1), F.lit(0)
    ll = pos * log_loss_term(pc, one) + neg * log_loss_term(pc, zero)
    br = pos * brier_term(pc, one) + neg * brier_term(pc, zero)
    n = F.sum(F.col("__pos") + F.col("__neg"))
    base = sc.groupBy(*keys).agg(
        n.alias("n"),
        F.sum("__pos").alias("goals"),
        (F.sum(ll) / n.cast("double")).alias("log_loss"),
        (F.sum(br) / n.cast("double")).alias("brier"),
    )
    # One row per group on either side: Spark's own size estimate decides.
    return base.join(_auc_from_counts(sc, keys, buckets, n_scores), keys, "left") \
               .select(*keys, "n", "goals", "log_loss", "roc_auc", "brier")


def cv_summary(metrics: DataFrame, cols: Sequence[str] = ("log_loss", "roc_auc", "brier")) -> DataFrame:
    """Mean and population standard deviation of each metric over folds (A5)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return metrics.agg(F.count(F.lit(1)).alias("folds"), *aggs)
