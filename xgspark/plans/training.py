"""Train and evaluate (E2): grouped k-fold CV, metrics, final model, save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xgspark.config import FEATURE_COLUMNS, GROUP_COLUMN, N_SPLITS, TARGET_COLUMN
from xgspark.operators.cleaning import drop_missing
from xgspark.operators.folds import check_no_leakage, group_kfold, group_summary, sizes_of_summary
from xgspark.operators.metrics import cv_summary, fold_metrics
from xgspark.operators.model import fit_final, fit_folds, score_oof
from xgspark.session import materialize
from xgspark.sources.model_io import save_model


@dataclass
class TrainingReport:
    fold_models: DataFrame
    fold_metrics: DataFrame
    fold_sizes: DataFrame
    cv_summary: DataFrame
    final_model: DataFrame
    rows_dropped: int
    n_rows: int          # training rows after the missing-value drop
    n_groups: int        # distinct groups (matches), exact


def prepare(shots: DataFrame, k: int = N_SPLITS, method: str = "greedy") -> tuple[DataFrame, object]:
    """Training columns only (P5, Catalyst prunes the rest), missing rows
    dropped and counted (F7), folds attached (G1, J4)."""
    cols = [*FEATURE_COLUMNS, TARGET_COLUMN, GROUP_COLUMN]
    clean, obs = drop_missing(shots.select(*cols), cols, "training_rows")
    return group_kfold(clean, GROUP_COLUMN, k, method), obs


def train(shots: DataFrame, out: str | None = None, k: int = N_SPLITS,
          method: str = "greedy", mllib_out: str | None = None, tol: float = 1e-6,
          max_iter: int = 100) -> TrainingReport:
    """Grouped CV with MLlib fits per fold, metrics, final fit, optional save.

    The folded training columns are written once to the shared checkpoint
    folder, so the k fits and the metric jobs read them (and restart from
    them after an executor loss) instead of re-reading the source.  One
    summary by (match, fold) answers the leakage check, the class counts, the
    fold sizes and the totals.
    """
    folded, obs = prepare(shots, k, method)
    folded = materialize(folded, "training-folds")
    dropped = int((obs.get or {}).get("rows_dropped") or 0)
    summary = materialize(group_summary(folded, label=TARGET_COLUMN), "fold-summary")
    check_no_leakage(summary)
    per_fold = summary.groupBy("fold").agg(F.sum("rows").alias("rows"), F.sum("pos").alias("pos"),
                                           F.count(F.lit(1)).alias("groups")).collect()      # k rows
    counts = sorted((int(r["fold"]), r["rows"], r["pos"] or 0) for r in per_fold)
    models = fit_folds(folded, counts=counts, tol=tol, max_iter=max_iter)
    metrics = materialize(fold_metrics(score_oof(folded, models)), "fold-metrics")
    rows, pos = sum(c[1] for c in counts), sum(c[2] for c in counts)
    final = fit_final(folded, mllib_out=mllib_out, counts=(rows, pos), tol=tol, max_iter=max_iter)
    if out:
        save_model(final, out)
    return TrainingReport(models, metrics, sizes_of_summary(summary), cv_summary(metrics), final, dropped,
                          int(rows), sum(r["groups"] for r in per_fold))
