import math

import pytest
from pyspark.sql import functions as F

from xgspark.functions.scoring import interpret_xg, round_half_even
from xgspark.plans.scoring import score_batch

# FIXED VALUES: bucket labels and the three preset shots.
BUCKETS = [
    (0.5, "High quality chance"), (0.9, "High quality chance"),
    (0.2, "Good chance"), (0.49999, "Good chance"),
    (0.08, "Moderate probability effort"), (0.19996, "Moderate probability effort"),
    (0.0, "Low probability effort"), (0.07999, "Low probability effort"),
    (float("nan"), "Low probability effort"),
]
MODEL = {"intercept": -1.0, "coef_distance": -0.1, "coef_angle": 0.03}


def test_buckets(spark):
    df = spark.createDataFrame([(p,) for p, _ in BUCKETS], "p double")
    got = [r.label for r in df.select(interpret_xg(F.col("p")).alias("label")).collect()]
    assert got == [label for _, label in BUCKETS]


def test_bucket_before_rounding(spark):
    r = spark.createDataFrame([(0.19996,)], "p double").select(
        interpret_xg(F.col("p")).alias("label"), round_half_even(F.col("p"), 4).alias("shown")).first()
    assert r.shown == 0.2 and r.label == "Moderate probability effort"


def _expected(d_m, a):
    yards = d_m * 1.09361
    p = 1.0 / (1.0 + math.exp(-(-1.0 + -0.1 * yards + 0.03 * a)))
    return p, yards


def test_preset_shots_and_rejections(spark):
    presets = [(1, 5.5, 65.0), (2, 11.0, 37.0), (3, 27.4, 15.0), (4, -3.0, 37.0)]
    df = spark.createDataFrame(presets, "request_id long, distance_meters double, angle_degrees double")
    out = {r.request_id: r for r in score_batch(df, MODEL).collect()}
    for rid, d, a in presets[:3]:
        p, yards = _expected(d, a)
        assert out[rid].status == "ok" and out[rid].http_status == 200
        assert out[rid].xg_probability == pytest.approx(p, abs=5e-5)
        assert out[rid].distance_yards == pytest.approx(yards, abs=5e-5)
    assert out[4].status == "rejected" and out[4].http_status == 422 and out[4].xg_probability is None
    # score falls as distance grows with a negative distance coefficient
    assert out[1].xg_probability > out[2].xg_probability > out[3].xg_probability


def test_command_line_path_scores_without_validation(spark):
    df = spark.createDataFrame([(1, -3.0, 37.0)], "request_id long, distance_meters double, angle_degrees double")
    r = score_batch(df, MODEL, validate=False).first()
    assert r.status == "ok" and r.xg_probability is not None


def test_missing_input_has_no_bucket(spark):
    df = spark.createDataFrame([(1, None, 37.0), (2, float("nan"), 37.0), (3, 11.0, None)],
                               "request_id long, distance_meters double, angle_degrees double")
    for r in score_batch(df, MODEL, validate=False).collect():
        assert (r.status, r.xg_probability, r.interpretation) == ("rejected", None, None)
    assert spark.range(1).select(interpret_xg(F.lit(None).cast("double")).alias("x")).first().x is None


def test_model_unavailable(spark):
    df = spark.createDataFrame([(1, 11.0, 37.0), (2, 0.0, 37.0)],
                               "request_id long, distance_meters double, angle_degrees double")
    out = {r.request_id: r for r in score_batch(df, None).collect()}
    assert out[1].status == "model_unavailable" and out[1].http_status == 503
    assert out[1].gateway_status == 502 and out[2].gateway_status == 422
    assert out[2].status == "rejected"


def test_responses_round_the_exact_value_half_to_even(spark):
    import random

    rnd = random.Random(1)
    values = [m * 1.09361 for m in range(1, 1001)] + [k / 10000 + 0.00005 for k in range(2000)]
    values += [k / 32 for k in range(-400, 400)]                                        # exact ties
    values += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 19) for _ in range(2000)]
    values += [0.0, -0.0, 5e-5, -5e-5, 4.9999e-5, 1e300, 2.0 ** 52 - 0.5, 1e400, -1e400]
    for d in (4, 1):
        rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_half_even("v", d).alias("r"))
        for r in rows.collect():
            assert r.r == (round(r.v, d) if math.isfinite(r.v) else r.v), r.v
    far = spark.createDataFrame([(1, 5.0, 10.0), (2, 1e17, 10.0)], "request_id long, distance_meters double, angle_degrees double")
    assert [r.distance_yards for r in score_batch(far, MODEL).orderBy("request_id").collect()] == [5.468, 1e17 * 1.09361]
