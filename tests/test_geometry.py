import math

import pytest
from pyspark.sql import functions as F

from xgspark.functions.geometry import distance_to_goal, shot_angle, to_yards

# x, y, distance, angle (degrees), from the formulas by hand (FIXTURES.md section 2)
CASES = [
    (108.0, 40.0, 12.0, 36.869898),
    (60.0, 40.0, 60.0, 7.62815),
    (114.0, 30.0, 11.661904, 21.801409),
    (102.5, 33.25, 18.756665, 22.631222),
    (119.0, 10.0, 30.016662, 0.517914),
    (0.0, 0.0, 126.491106, 3.437059),
    (120.0, 40.0, 0.0, 180.0),
    (120.0, 36.0, 4.0, 90.0),
    (125.0, 40.0, 5.0, 77.319617),
]


def test_geometry_fixture_values(spark):
    df = spark.createDataFrame([(c[0], c[1]) for c in CASES], "x double, y double")
    rows = df.select("x", "y", distance_to_goal("x", "y").alias("d"),
                     shot_angle("x", "y").alias("a")).collect()
    got = {(r.x, r.y): (r.d, r.a) for r in rows}
    for x, y, d, a in CASES:
        gd, ga = got[(x, y)]
        assert gd == pytest.approx(d, abs=1e-6)
        assert ga == pytest.approx(a, abs=1e-5)


def test_angle_range_and_symmetry(spark):
    df = spark.range(0, 2000).select(
        ((F.col("id") * 37) % 1300 / 10.0).alias("x"), ((F.col("id") * 53) % 800 / 10.0).alias("y"))
    out = df.select("x", "y", shot_angle("x", "y").alias("a"),
                    shot_angle("x", F.lit(80.0) - F.col("y")).alias("mirror")).collect()
    for r in out:
        assert 0.0 <= r.a <= 180.0
        assert r.a == pytest.approx(r.mirror, abs=1e-9)


def test_to_yards(spark):
    r = spark.range(1).select(to_yards(F.lit(11.0)).alias("y")).first()
    assert r.y == pytest.approx(11.0 * 1.09361)
    assert math.isclose(r.y, 12.02971, rel_tol=1e-12)
