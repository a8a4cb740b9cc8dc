"""Logistic-regression fitting and scoring.

Fits use MLlib: the objective reproduced is ``sum(log loss) + 0.5 * |w|^2``
with a free intercept and unscaled features, which is MLlib's
``mean(log loss) + regParam / 2 * |w|^2`` with ``regParam = 1 / n_train``
and ``standardization = False``.  Each fit is a distributed L-BFGS over the
(persisted) training rows; only coefficients come back to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xgspark.config import FEATURE_COLUMNS, GROUP_COLUMN, TARGET_COLUMN
from xgspark.functions.scoring import logistic_probability
from xgspark.operators.joins import broadcast_if_small
from xgspark.schemas import MODEL_TABLE_SCHEMA
from xgspark.session import materialize


class DegenerateFoldError(ValueError):
    """A training fold holds a single class: the intercept has no finite optimum."""


class UnknownFeaturesError(ValueError):
    """A model table whose feature order is not known."""


class NoFinalModelError(LookupError):
    """A model table without a final (fold-less) model."""


def assemble(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
             label: str = TARGET_COLUMN, group: str | None = GROUP_COLUMN,
             out: str = "features") -> DataFrame:
    """Feature vector, label and group by name in the trained order (P5).

    Only these columns are selected, so Catalyst prunes every other column
    down to the scan.
    """
    from pyspark.ml.feature import VectorAssembler

    cols = [*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias(label)]
    if group:
        cols.append(F.col(group))
    assembled = VectorAssembler(inputCols=list(features), outputCol=out,
                                handleInvalid="error").transform(df.select(*cols))
    return assembled.select(out, label, *([group] if group else []))


WEIGHT = "__times"


def distinct_rows(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Equal training rows as one row with their number (``__times``): combined
    within each task before the shuffle.  Shots repeat, as places are given to a
    tenth of a unit, so the fits' passes read far fewer rows."""
    return df.groupBy(*keys, *[F.col(c).cast("double").alias(c) for c in features],
                      F.col(label).cast("double").alias(label)).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))


def _fit(df: DataFrame, features: Sequence[str], label: str, n_train: int,
         max_iter: int, tol: float):
    """A fit of distinct rows: with weights the loss is the same mean over all
    ``n_train`` rows, so the objective does not change."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="error") \
        .transform(df).select("__features", label, WEIGHT)
    lr = LogisticRegression(featuresCol="__features", labelCol=label,
                            weightCol=WEIGHT, regParam=1.0 / float(n_train), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True,
                            maxIter=max_iter, tol=tol, family="binomial")
    return lr.fit(assembled)


def _model_row(m, fold, n_train: int, features: Sequence[str]) -> tuple:
    """Coefficients by feature name, whatever the order they were fitted in."""
    coef = dict(zip(features, m.coefficients.toArray().tolist()))
    check_order(features)
    distance, angle = FEATURE_COLUMNS
    return (fold, float(coef[distance]), float(coef[angle]), float(m.intercept), list(features), int(n_train))


def check_order(features: Sequence[str] | None) -> None:
    """A model table's feature order must name the known features, each once."""
    if sorted(features or ()) != sorted(FEATURE_COLUMNS):
        raise UnknownFeaturesError(f"unknown feature order {features!r}; expected {FEATURE_COLUMNS}")


def class_counts(df: DataFrame, label: str = TARGET_COLUMN, fold: str = "fold") -> list[tuple[int, int, int]]:
    """``(fold, rows, positives)`` of the k folds (one small aggregate)."""
    times = F.col(WEIGHT).cast("long") if WEIGHT in df.columns else F.lit(1)
    rows = df.groupBy(fold).agg(F.sum(times).alias("rows"),
                                F.coalesce(F.sum(F.col(label).cast("long") * times), F.lit(0)).alias("pos")).collect()
    return sorted((int(r[fold]), r["rows"], r["pos"]) for r in rows)


def fit_folds(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
              label: str = TARGET_COLUMN, fold: str = "fold",
              max_iter: int = 100, tol: float = 1e-6, parallelism: int = 2,
              counts: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Fit one model per fold on the complement of the fold.

    Returns the model table keyed by ``fold``.  A training side with a
    single class raises :class:`DegenerateFoldError` before any fit.  The
    distinct (fold, features, label) rows with their counts are written once, in
    as few files as they need (every pass of a fit is a task a file); class
    counts (unless given) and all fits read them.  Each fit
    caches its own training side while it runs, so ``parallelism`` bounds the
    copies.
    """
    from concurrent.futures import ThreadPoolExecutor

    check_order(features)
    work = materialize(distinct_rows(df, features, label, [fold]), "training-rows")
    counts = counts or class_counts(work, label, fold)
    total_rows, total_pos = sum(c[1] for c in counts), sum(c[2] for c in counts)

    def one(f_rows_pos):
        f, rows, pos = f_rows_pos
        m = _fit(work.filter(F.col(fold) != F.lit(f)), features, label, total_rows - rows, max_iter, tol)
        return _model_row(m, f, total_rows - rows, features)

    for f, rows, pos in counts:
        n_train, pos_train = total_rows - rows, total_pos - pos
        if n_train == 0 or pos_train == 0 or pos_train == n_train:
            raise DegenerateFoldError(
                f"fold {f}: training side has a single class ({pos_train} positives of {n_train})")
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(counts)))) as ex:
        rows = list(ex.map(one, counts))
    return df.sparkSession.createDataFrame(rows, MODEL_TABLE_SCHEMA)


def fit_final(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
              label: str = TARGET_COLUMN, max_iter: int = 100, tol: float = 1e-6,
              mllib_out: str | None = None, counts: tuple[int, int] | None = None) -> DataFrame:
    """Fit the final model on all rows (G5); one-row model table, ``fold`` NULL.

    ``counts`` are (rows, positives) when already known.  ``mllib_out`` also
    saves the fitted MLlib model (``write().overwrite()``) for use in MLlib
    pipelines.
    """
    check_order(features)
    if counts is None:
        agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).first()
        counts = agg["n"], agg["pos"] or 0
    n, pos = counts
    if n == 0 or pos == 0 or pos == n:
        raise DegenerateFoldError(f"training data has a single class ({pos} positives of {n})")
    m = _fit(materialize(distinct_rows(df, features, label), "training-rows"), features, label, n, max_iter, tol)
    if mllib_out:
        m.write().overwrite().save(mllib_out)
    return df.sparkSession.createDataFrame([_model_row(m, None, n, features)], MODEL_TABLE_SCHEMA)


def coefficients(model_table: DataFrame) -> DataFrame:
    """Coefficients and intercept by name (G6): ``fold, term, value``."""
    return model_table.select(
        "fold",
        F.explode(F.array(
            F.struct(F.lit("distance_to_goal").alias("term"), F.col("coef_distance").alias("value")),
            F.struct(F.lit("shot_angle").alias("term"), F.col("coef_angle").alias("value")),
            F.struct(F.lit("intercept").alias("term"), F.col("intercept").alias("value")),
        )).alias("t")).select("fold", "t.term", "t.value")


def score_oof(df: DataFrame, fold_models: DataFrame, fold: str = "fold", out: str = "p") -> DataFrame:
    """Out-of-fold probabilities: each row scored by its fold's model.

    Coefficients apply by feature name; a model whose feature order is not
    known fails the job.  The model table has one row per fold; it is
    broadcast after a bounded count.
    """
    known = F.array_sort("feature_order").eqNullSafe(F.array(*[F.lit(c) for c in sorted(FEATURE_COLUMNS)]))
    m = fold_models.filter(F.col("fold").isNotNull()).select(
        F.col("fold").alias(fold),
        F.when(known, F.col("intercept")).otherwise(
            F.raise_error(F.lit("unknown feature order in the model table")).cast("double")).alias("__b0"),
        F.col("coef_distance").alias("__b1"), F.col("coef_angle").alias("__b2"))
    j = df.join(broadcast_if_small(m), fold, "inner")
    return j.withColumn(out, logistic_probability("__b0", ("__b1", "__b2"), FEATURE_COLUMNS)) \
            .drop("__b0", "__b1", "__b2")


def model_as_dict(model_table: DataFrame) -> dict:
    """The final-model row as a dict (one row to the driver); a table without
    one raises, as does an unknown feature order."""
    row = model_table.filter(F.col("fold").isNull()).first()
    if row is None:
        raise NoFinalModelError("the model table has no final model (fold NULL)")
    check_order(row["feature_order"])
    return row.asDict()
