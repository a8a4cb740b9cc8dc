from pyspark.sql import functions as F
from pyspark.sql import types as T

from xgspark.operators.cleaning import (
    clean_shots, drop_missing, drop_penalties, drop_shootout, flatten_shots, only_shots,
    with_location_xy,
)
from xgspark.schemas import CLEAN_SHOTS_SCHEMA

NAMED = "struct<id:bigint,name:string>"
RAW_SCHEMA = (f"eid int, match_id bigint, type {NAMED}, period int, minute int, location string, "
              f"shot_type_name string, shot_type string, shot_outcome {NAMED}, player {NAMED}, "
              f"player_name string, team_name string, team {NAMED}, shot_statsbomb_xg double")


def _row(eid, location="[100.0, 40.0]", shot_type="Open Play", period=1, outcome="Saved",
         player=(1, "P"), player_name=None, team_name="T", team=(2, "Club"), type_name="Shot",
         shot_type_name=None):
    return (eid, 7, None if type_name is None else (16, type_name), period, 10, location,
            shot_type_name, shot_type, None if outcome is None else (1, outcome),
            None if player is None else player, player_name, team_name, team, 0.1)


def test_location_cases(spark):
    locs = [None, '"oops"', "[100.0]", "[null, 40]", '["a", 40]', '["107.5", 41, 0.3]', '["nan", 40]']
    df = spark.createDataFrame([(i, l) for i, l in enumerate(locs)], "i int, location string")
    got = {r.i: (r.x, r.y) for r in with_location_xy(df).collect()}
    assert got[0] == (None, None)
    assert got[1] == (None, None)
    assert got[2][1] is None
    assert got[3][0] is None
    assert got[4][0] is None
    assert got[5] == (107.5, 41.0)
    assert got[6][0] != got[6][0]  # NaN survives the parse ...
    rows = [_row(i, location=l) for i, l in enumerate(locs)]
    out = clean_shots(spark.createDataFrame(rows, RAW_SCHEMA)).collect()
    assert [(r.x, r.y) for r in out] == [(107.5, 41.0)]  # ... and the final drop removes it


def test_null_safe_filters_keep_nulls(spark):
    rows = [_row(1, shot_type="Penalty"), _row(2, shot_type=None), _row(3, period=5),
            _row(4, period=None), _row(5)]
    df = spark.createDataFrame(rows, RAW_SCHEMA)
    kept = sorted(r.eid for r in drop_shootout(drop_penalties(df)).collect())
    assert kept == [2, 4, 5]
    assert clean_shots(df).count() == 3


def test_outcome_null_is_zero_and_goal_is_one(spark):
    rows = [_row(1, outcome=None), _row(2, outcome="Goal"), _row(3, outcome="Saved")]
    out = flatten_shots(spark.createDataFrame(rows, RAW_SCHEMA).orderBy("eid")).collect()
    assert [r.is_goal for r in out] == [0, 1, 0]


def test_name_lookup_record_with_null_name_does_not_fall_through(spark):
    # player_name (flat) is NULL -> next candidate 'player' is a record whose name is NULL:
    # the NULL is returned, no further fall-through.
    rows = [_row(1, player=(1, None), player_name=None),
            _row(2, player=(1, "Rec"), player_name="Flat"),
            _row(3, player=None, player_name=None),
            _row(4, team_name=None, team=(9, "Club 9")),
            _row(5, shot_type_name=None, shot_type="Open Play")]
    out = flatten_shots(spark.createDataFrame(rows, RAW_SCHEMA).orderBy("eid")).collect()
    assert [r.player_name for r in out] == [None, "Flat", None, "P", "P"]
    assert out[3].team_name == "Club 9"
    assert out[4].shot_type == "Open Play"


def test_only_shots_drops_null_and_other_types(spark):
    rows = [_row(1, type_name=None), _row(2, type_name="Pass"), _row(3)]
    assert [r.eid for r in only_shots(spark.createDataFrame(rows, RAW_SCHEMA)).collect()] == [3]


def test_schema_and_absent_optional_columns(spark):
    df = spark.createDataFrame([("[110.0, 40.0]", "Shot")], "location string, type string")
    out = clean_shots(df)
    assert [(f.name, f.dataType) for f in out.schema.fields] == \
        [(f.name, f.dataType) for f in CLEAN_SHOTS_SCHEMA.fields]
    r = out.first()
    assert r.match_id is None and r.player_name is None and r.is_goal == 0
    assert r.distance_to_goal == 10.0


def test_off_pitch_coordinates_are_kept(spark):
    df = spark.createDataFrame([("[130.0, -5.0]", "Shot")], "location string, type string")
    assert clean_shots(df).count() == 1


def test_drop_missing_counts_with_observe(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 1), (None, 0), (2.0, None)], "x double, g int")
    out, obs = drop_missing(df, ["x", "g"])
    assert out.count() == 1
    assert obs.get["rows_dropped"] == 3 and obs.get["rows_in"] == 4


def test_variant_location_column(spark):
    df = spark.createDataFrame([('[101.5, "39"]',)], "j string").select(F.parse_json("j").alias("location"))
    assert isinstance(df.schema["location"].dataType, T.VariantType)
    r = with_location_xy(df).first()
    assert (r.x, r.y) == (101.5, 39.0)


def test_array_location_column(spark):
    df = spark.createDataFrame([(["101.5", "39", "7"],), (["5"],), (None,), (["a", "1"],)],
                               "location array<string>")
    got = [(r.x, r.y) for r in with_location_xy(df).collect()]
    assert got == [(101.5, 39.0), (5.0, None), (None, None), (None, 1.0)]


def test_name_field_map_and_numeric_candidates(spark):
    from xgspark.functions.fields import name_field

    df = spark.createDataFrame([({"name": "M"}, None), (None, "flat"), ({"id": "1"}, "flat2")],
                               "player map<string,string>, player_name string")
    got = [r.n for r in df.select(name_field(df, ["player", "player_name"]).alias("n")).collect()]
    # a present map returns its 'name' (NULL when absent), no fall-through; NULL map falls through
    assert got == ["M", "flat", None]
    nums = spark.createDataFrame([(float("nan"), "b"), (1.5, "c")], "a double, b string")
    got = [r.n for r in nums.select(name_field(nums, ["a", "b"]).alias("n")).collect()]
    assert got == ["b", "1.5"]
