"""Fixed schemas of the data model."""

from pyspark.sql import types as T

NAMED = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])

CLEAN_SHOTS_SCHEMA = T.StructType([
    T.StructField("match_id", T.LongType()),
    T.StructField("player_name", T.StringType()),
    T.StructField("team_name", T.StringType()),
    T.StructField("minute", T.IntegerType()),
    T.StructField("period", T.IntegerType()),
    T.StructField("body_part", T.StringType()),
    T.StructField("shot_type", T.StringType()),
    T.StructField("statsbomb_xg", T.DoubleType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("is_goal", T.IntegerType()),
    T.StructField("distance_to_goal", T.DoubleType()),
    T.StructField("shot_angle", T.DoubleType()),
])

COMPETITIONS_SCHEMA = T.StructType([
    T.StructField("competition_id", T.LongType()),
    T.StructField("competition_name", T.StringType()),
    T.StructField("season_id", T.LongType()),
    T.StructField("season_name", T.StringType()),
])

MATCHES_SCHEMA = T.StructType([
    T.StructField("match_id", T.LongType()),
    T.StructField("competition", T.StructType([
        T.StructField("competition_id", T.LongType()),
        T.StructField("competition_name", T.StringType())])),
    T.StructField("season", T.StructType([
        T.StructField("season_id", T.LongType()),
        T.StructField("season_name", T.StringType())])),
])

# Raw event files.  Every ragged field is VARIANT (a record, a flat value, text
# for a number, ...): one odd field never costs the event, and what is read
# does not depend on which columns are asked for.
_RAGGED = T.VariantType()
EVENT_NAMES = ("type", "player", "team", "shot_type", "shot_outcome", "shot_body_part")
EVENT_FLAT_NAMES = ("player_name", "team_name", "shot_type_name", "shot_outcome_name", "shot_body_part_name")
CORRUPT = "_corrupt_record"
EVENTS_SCHEMA = T.StructType(
    [T.StructField(c, _RAGGED) for c in (*EVENT_NAMES, *EVENT_FLAT_NAMES, "period", "minute", "location",
                                         "shot_statsbomb_xg")]
    + [T.StructField("shot", T.StructType([T.StructField(c, _RAGGED)
                                           for c in ("type", "outcome", "body_part", "statsbomb_xg")])),
       T.StructField(CORRUPT, T.StringType())])

MODEL_TABLE_SCHEMA = T.StructType([
    T.StructField("fold", T.IntegerType()),
    T.StructField("coef_distance", T.DoubleType()),      # of distance_to_goal
    T.StructField("coef_angle", T.DoubleType()),         # of shot_angle
    T.StructField("intercept", T.DoubleType()),
    T.StructField("feature_order", T.ArrayType(T.StringType())),
    T.StructField("n_train", T.LongType()),
])
