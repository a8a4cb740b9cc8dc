import pytest

from tests.conftest import SF_MID
from xgspark.operators.model import assemble, model_as_dict
from xgspark.plans.scoring import score_batch
from xgspark.plans.training import train
from xgspark.sources.model_io import ModelUnavailable, load_model
from xgspark.sources.tables import requests_view, shots_view


def test_train_end_to_end_and_score_with_saved_model(spark, tmp_path):
    out = str(tmp_path / "model")
    rep = train(shots_view(spark, SF_MID), out)
    assert rep.rows_dropped == 0
    assert (rep.n_rows, rep.n_groups) == (10000, 150)
    metrics = rep.fold_metrics.collect()
    assert len(metrics) == 5
    assert all(0.5 < r.roc_auc <= 1.0 and 0 < r.brier < 0.25 for r in metrics)
    s = rep.cv_summary.first()
    assert s.folds == 5 and s.roc_auc_std >= 0
    assert sum(r.test_rows for r in rep.fold_sizes.collect()) == 10000
    model = load_model(spark, out)
    m = model_as_dict(model)
    assert m["feature_order"] == ["distance_to_goal", "shot_angle"]
    assert m["coef_distance"] < 0 < m["coef_angle"]
    scored = score_batch(requests_view(spark, SF_MID), m)
    assert scored.filter("status = 'ok' AND xg_probability IS NULL").count() == 0
    # the loaded table itself can be passed
    again = score_batch(requests_view(spark, SF_MID), model)
    assert again.drop("errors").exceptAll(scored.drop("errors")).count() == 0


def test_missing_model(spark, tmp_path):
    missing = str(tmp_path / "nope")
    with pytest.raises(ModelUnavailable):
        load_model(spark, missing)
    assert load_model(spark, missing, on_missing="mark") is None


def test_empty_model_table_is_missing(spark, tmp_path):
    from xgspark.schemas import MODEL_TABLE_SCHEMA

    path = str(tmp_path / "empty")
    spark.createDataFrame([], MODEL_TABLE_SCHEMA).write.parquet(path)
    assert load_model(spark, path, on_missing="mark") is None
    with pytest.raises(ModelUnavailable):
        load_model(spark, path)


def test_training_drops_rows_with_missing_values(spark):
    from pyspark.sql import functions as F

    shots = shots_view(spark, SF_MID).withColumn(
        "shot_angle", F.when(F.col("shot_id") % 101 == 0, None).when(F.col("shot_id") % 103 == 0, float("nan"))
                       .otherwise(F.col("shot_angle")))
    bad = shots.filter(F.col("shot_angle").isNull() | F.isnan("shot_angle")).count()
    rep = train(shots)
    assert rep.rows_dropped == bad > 0 and rep.n_rows == 10000 - bad


def test_assemble_order(spark):
    a = assemble(shots_view(spark, SF_MID).limit(3))
    assert a.columns == ["features", "is_goal", "match_id"]
    r = a.first()
    assert len(r.features) == 2
