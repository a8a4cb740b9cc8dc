"""Views over the benchmark tables.

The benchmark tables hold no football data, so shot-shaped inputs are derived
from them with integer arithmetic first (identical in every SQL engine):

* ``events``   -> shots (one shot per event, ``match_id = user_id``), raw
  shot-shaped events, score requests and JSON request bodies;
* ``nation`` + ``region`` -> competitions catalogue (a region is a
  competition, a nation one of its seasons);
* ``customer`` -> matches (``c_custkey`` is the match id, ``c_nationkey`` its
  season).

FIXED VALUES: the derivation rules below are the fixtures' definitions and
are mirrored one to one by the DuckDB oracle SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xgspark.functions.geometry import distance_to_goal, shot_angle
from xgspark.functions.scoring import logistic_probability

# --- FIXED VALUES: the fixture model used to label shots (intercept, distance, angle) ---
FIXTURE_MODEL = (-1.0, -0.1, 0.03)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# FIXED VALUES: the columns of the benchmark tables that are read, with their
# stored types.  Declared, not inferred: no footer-reading job per read, and
# only these columns can ever be requested from the files.
TABLE_SCHEMAS = {
    "events": "event_id bigint, user_id bigint, event_type string, value double, props string",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# A scan with very few splits holds at most a few row groups: this many
# pieces are plenty for it, whatever the cluster size.
SPREAD_MAX_PARTITIONS = 64


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when a scan yields fewer splits than the
    cluster can run at once (e.g. one Parquet row group), up to
    ``SPREAD_MAX_PARTITIONS`` pieces.

    For CPU-heavy per-row work (JSON parsing).  On large inputs the scan
    already has thousands of splits and this is a no-op: no extra shuffle.
    """
    try:
        target = min_partitions or min(df.sparkSession.sparkContext.defaultParallelism,
                                       SPREAD_MAX_PARTITIONS)
        n = df.rdd.getNumPartitions()
    except Exception:  # no RDD view of the plan (e.g. a Connect session): leave as is
        return df
    return df.repartition(target) if n < target else df


def _x(eid: Column) -> Column:
    return F.lit(60.0) + (eid * 37 % 600) / F.lit(10.0)


def _y(eid: Column) -> Column:
    return (eid * 53 % 800) / F.lit(10.0)


def shots_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, featured shots: ``shot_id, match_id, x, y, distance_to_goal,
    shot_angle, is_goal`` (is_goal drawn from the fixture model)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    eid = F.col("event_id")
    b0, b1, b2 = FIXTURE_MODEL
    return (e.select(eid.alias("shot_id"), F.col("user_id").alias("match_id"),
                     _x(eid).alias("x"), _y(eid).alias("y"))
             .withColumn("distance_to_goal", distance_to_goal("x", "y"))
             .withColumn("shot_angle", shot_angle("x", "y"))
             .withColumn("is_goal", F.when(
                 (F.col("shot_id") * 7919 % 1000) / F.lit(1000.0)
                 < logistic_probability(b0, (b1, b2), ("distance_to_goal", "shot_angle")),
                 F.lit(1)).otherwise(F.lit(0))))


def fixture_probability() -> Column:
    """Probability of the fixture model on ``distance_to_goal, shot_angle``."""
    b0, b1, b2 = FIXTURE_MODEL
    return logistic_probability(b0, (b1, b2), ("distance_to_goal", "shot_angle"))


def _dec_sql(k: str, offset: int) -> str:
    """SQL for the decimal text ``offset + k/10`` built from integers ('60.3')."""
    return f"concat(cast({offset} + floor(({k}) / 10) AS STRING), '.', cast(({k}) % 10 AS STRING))"


_XT = _dec_sql("event_id * 37 % 600", 60)
_YT = _dec_sql("event_id * 53 % 800", 0)
_NAMED_NULL = "CAST(NULL AS STRUCT<id: BIGINT, name: STRING>)"

# The raw shot-shaped event view as SQL expressions over ``events``: one
# parse on the JVM side instead of hundreds of Column calls.
RAW_EVENT_EXPRS = (
    "event_id",
    "user_id AS match_id",
    f"""CASE WHEN event_id % 53 = 0 THEN {_NAMED_NULL}
             ELSE named_struct('id', CAST(16 AS BIGINT), 'name',
                               CASE WHEN event_id % 47 = 0 THEN 'Pass' ELSE 'Shot' END) END AS type""",
    "CASE WHEN event_id % 37 = 0 THEN CAST(NULL AS INT) ELSE CAST(1 + event_id % 5 AS INT) END AS period",
    "CAST(event_id % 95 AS INT) AS minute",
    f"""CASE WHEN event_id % 31 = 0 THEN CAST(NULL AS STRING)
             WHEN event_id % 41 = 0 THEN '[100.0]'
             WHEN event_id % 67 = 0 THEN '"oops"'
             WHEN event_id % 73 = 0 THEN concat('[null, ', {_YT}, ']')
             WHEN event_id % 71 = 0 THEN concat('["', {_XT}, '", ', {_YT}, ', 0.3]')
             WHEN event_id % 79 = 0 THEN concat('["nan", ', {_YT}, ']')
             ELSE concat('[', {_XT}, ', ', {_YT}, ']') END AS location""",
    """CASE WHEN event_id % 23 = 0 THEN 'Penalty' WHEN event_id % 29 = 0 THEN CAST(NULL AS STRING)
             ELSE 'Open Play' END AS shot_type""",
    """CASE WHEN event_type = 'purchase' THEN 'Goal' WHEN event_type = 'error' THEN CAST(NULL AS STRING)
             ELSE 'Saved' END AS shot_outcome""",
    f"""CASE WHEN event_id % 59 = 0 THEN {_NAMED_NULL}
             ELSE named_struct('id', event_id % 3, 'name',
                               CASE WHEN event_id % 3 = 0 THEN 'Right Foot'
                                    WHEN event_id % 3 = 1 THEN 'Left Foot' ELSE 'Head' END) END AS shot_body_part""",
    """named_struct('id', user_id, 'name',
                    CASE WHEN user_id % 11 = 0 THEN CAST(NULL AS STRING)
                         ELSE concat('Player ', CAST(user_id AS STRING)) END) AS player""",
    """CASE WHEN event_id % 13 = 0 THEN CAST(NULL AS STRING)
             ELSE concat('Team ', CAST(user_id % 32 AS STRING)) END AS team_name""",
    "named_struct('id', user_id % 32, 'name', concat('Club ', CAST(user_id % 32 AS STRING))) AS team",
    "value / 100.0D AS shot_statsbomb_xg",
)


def raw_events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw shot-shaped events, flat and nested fields mixed as they arrive.

    Columns: ``event_id, match_id, type struct<id,name>, period, minute,
    location (JSON text), shot_type, shot_outcome, shot_body_part
    struct<id,name>, player struct<id,name>, team_name, team struct<id,name>,
    shot_statsbomb_xg``.
    """
    e = spread(read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"))
    return e.selectExpr(*RAW_EVENT_EXPRS)


def competitions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitions catalogue: ``competition_id, competition_name, season_id, season_name``."""
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(n.n_regionkey.cast("bigint").alias("competition_id"),
                     r.r_name.alias("competition_name"),
                     n.n_nationkey.cast("bigint").alias("season_id"),
                     n.n_name.alias("season_name")))


def matches_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches: ``match_id, season_id``."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(c.c_custkey.cast("bigint").alias("match_id"),
                    c.c_nationkey.cast("bigint").alias("season_id"))


# Typed score requests derived from ``events`` (shared by the batch view and
# the streaming source, so the two always see the same requests).
REQUEST_EXPRS = (
    "event_id AS request_id",
    "CAST((event_id % 50) - 2 AS DOUBLE) AS distance_meters",
    "CAST((event_id * 7 % 200) - 5 AS DOUBLE) AS angle_degrees",
)


def requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed score requests: ``request_id, distance_meters, angle_degrees``
    (includes out-of-range values on purpose)."""
    return read_table(spark, sf_dir, "events").select("event_id").selectExpr(*REQUEST_EXPRS)


_D = "CAST((event_id % 50) - 2 AS STRING)"
_A = "CAST((event_id * 7 % 200) - 5 AS STRING)"
JSON_BODY_EXPR = f"""CASE
    WHEN event_id % 97 = 0 THEN '[1, 2]'
    WHEN event_id % 89 = 0 THEN 'not json'
    WHEN event_id % 83 = 0 THEN '{{}}'
    WHEN event_id % 79 = 0 THEN concat('{{"distance_meters": 1e400, "angle_degrees": ', {_A}, '}}')
    WHEN event_id % 73 = 0 THEN concat('{{"distance_meters": -3, "angle_degrees": ', {_A}, ', "distance_meters": ', {_D}, '}}')
    WHEN event_id % 71 = 0 THEN concat('{{"angle_degrees": 10, "x": {{"a": 1, "a": 2}}, "distance_meters": ', {_D}, ', "angle_degrees": null}}')
    WHEN event_id % 13 = 0 THEN concat('{{"angle_degrees": ', {_A}, '}}')
    WHEN event_id % 17 = 0 THEN concat('{{"distance_meters": ', {_D}, '}}')
    WHEN event_id % 19 = 0 THEN concat('{{"distance_meters": null, "angle_degrees": ', {_A}, '}}')
    WHEN event_id % 11 = 0 THEN concat('{{"distance_meters": "', {_D}, '", "angle_degrees": ', {_A}, '}}')
    WHEN event_id % 7 = 0 THEN concat('{{"distance_meters": true, "angle_degrees": ', {_A}, '}}')
    WHEN event_id % 5 = 0 THEN concat('{{"distance_meters": ', {_D}, '.5, "angle_degrees": "', {_A}, '"}}')
    ELSE concat('{{"distance_meters": ', {_D}, ', "angle_degrees": ', {_A}, '}}') END AS body"""


def json_requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON request bodies: ``request_id, body``.

    Mixes valid bodies, absent fields, JSON nulls, numeric text, booleans,
    fractional and out-of-range numbers, repeated keys, non-object and non-JSON
    bodies.
    """
    e = spread(read_table(spark, sf_dir, "events").select("event_id"))
    return e.selectExpr("event_id AS request_id", JSON_BODY_EXPR)
