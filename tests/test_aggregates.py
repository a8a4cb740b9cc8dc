from xgspark.operators.aggregates import shot_summary
from xgspark.operators.sets import distinct_ids, union_ragged


def test_shot_summary_empty_and_values(spark):
    empty = spark.createDataFrame([], "match_id long, is_goal int")
    r = shot_summary(empty).first()
    assert (r.shots, r.goals, r.conversion_rate, r.matches) == (0, 0, 0.0, 0)
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 1)], "match_id long, is_goal int")
    r = shot_summary(df).first()
    assert (r.shots, r.goals, r.conversion_rate, r.matches) == (4, 2, 0.5, 2)


def test_union_ragged_and_distinct_ids(spark):
    a = spark.createDataFrame([(1, 0.5)], "match_id long, value double")
    b = spark.createDataFrame([(2, "x"), (None, "y")], "match_id long, props string")
    u = union_ragged([a, b])
    assert sorted(u.columns) == ["match_id", "props", "value"]
    assert u.count() == 3
    assert sorted(r.match_id for r in distinct_ids(u, "match_id").collect()) == [1, 2]
