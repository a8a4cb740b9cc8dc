import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from xgspark.operators.folds import group_kfold
from xgspark.operators.model import (
    DegenerateFoldError, coefficients, fit_final, fit_folds, score_oof,
)
from xgspark.sources.tables import shots_view


def _newton(X, y, iters=50):
    """argmin sum(logloss) + 0.5*|w|^2, intercept unpenalised (test reference)."""
    Xi = np.hstack([np.ones((X.shape[0], 1)), X])
    beta = np.zeros(Xi.shape[1])
    pen = np.diag([0.0] + [1.0] * X.shape[1])
    for _ in range(iters):
        p = 1.0 / (1.0 + np.exp(-Xi @ beta))
        g = Xi.T @ (p - y) + pen @ beta
        H = (Xi * (p * (1 - p))[:, None]).T @ Xi + pen
        step = np.linalg.solve(H, g)
        beta -= step
        if np.max(np.abs(step)) < 1e-12:
            break
    return beta


def test_fold_fits_match_newton(spark):
    folded = group_kfold(shots_view(spark, SF_MID))
    models = {r.fold: r for r in fit_folds(folded).collect()}
    pdf = folded.select("fold", "distance_to_goal", "shot_angle", "is_goal").toPandas()
    for f in (0, 3):
        tr = pdf[pdf.fold != f]
        b = _newton(tr[["distance_to_goal", "shot_angle"]].to_numpy(), tr.is_goal.to_numpy().astype(float))
        m = models[f]
        assert m.n_train == len(tr)
        assert (m.intercept, m.coef_distance, m.coef_angle) == pytest.approx(tuple(b), abs=1e-5)
    # scoring with the fitted table covers every row
    assert score_oof(folded, fit_folds(folded)).filter(F.col("p").isNull()).count() == 0


def test_final_model_signs(spark):
    coef = {r.term: r.value for r in coefficients(fit_final(shots_view(spark, SF_MID))).collect()}
    assert coef["distance_to_goal"] < 0 < coef["shot_angle"]


def test_single_class_training_fold_is_an_error(spark):
    df = spark.createDataFrame([(0, 10.0, 30.0, 0), (1, 12.0, 20.0, 0), (1, 5.0, 60.0, 1)],
                               "fold int, distance_to_goal double, shot_angle double, is_goal int")
    with pytest.raises(DegenerateFoldError):
        fit_folds(df)


def test_final_model_mllib_artifact(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    path = str(tmp_path / "mllib")
    table = fit_final(shots_view(spark, SF_MID), mllib_out=path).first()
    m = LogisticRegressionModel.load(path)
    assert list(m.coefficients) == pytest.approx([table.coef_distance, table.coef_angle])
    assert m.intercept == pytest.approx(table.intercept)


def test_swapped_feature_order_scores_the_same(spark):
    from xgspark.operators.model import model_as_dict
    from xgspark.plans.scoring import score_batch
    from xgspark.sources.tables import requests_view

    shots = shots_view(spark, SF_MID)
    usual = model_as_dict(fit_final(shots, tol=1e-10))
    swapped = model_as_dict(fit_final(shots, features=("shot_angle", "distance_to_goal"), tol=1e-10))
    for c in ("coef_distance", "coef_angle", "intercept"):
        assert swapped[c] == pytest.approx(usual[c], abs=1e-6)
    a, b = (score_batch(requests_view(spark, SF_MID), m).agg(F.sum("xg_probability")).first()[0]
            for m in (usual, swapped))
    assert a == pytest.approx(b, abs=0.5)


def test_unknown_order_and_missing_final_model_are_errors(spark):
    from pyspark.errors import PySparkException
    from xgspark.operators.model import NoFinalModelError, UnknownFeaturesError, model_as_dict
    from xgspark.schemas import MODEL_TABLE_SCHEMA

    fold_only = spark.createDataFrame([(0, -0.1, 0.03, -1.0, ["distance_to_goal", "shot_angle"], 5)], MODEL_TABLE_SCHEMA)
    with pytest.raises(NoFinalModelError):
        model_as_dict(fold_only)
    odd = spark.createDataFrame([(None, -0.1, 0.03, -1.0, ["x", "y"], 5)], MODEL_TABLE_SCHEMA)
    with pytest.raises(UnknownFeaturesError):
        model_as_dict(odd)
    odd_fold = spark.createDataFrame([(0, -0.1, 0.03, -1.0, ["x", "y"], 5)], MODEL_TABLE_SCHEMA)
    shots = shots_view(spark, SF_MID).limit(5).withColumn("fold", F.lit(0))
    with pytest.raises(PySparkException):
        score_oof(shots, odd_fold).collect()
    with pytest.raises(UnknownFeaturesError):
        fit_final(shots_view(spark, SF_MID), features=("x", "y"))
