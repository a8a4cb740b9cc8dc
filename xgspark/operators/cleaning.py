"""Filters and the shot flattening.

All filters are plain Catalyst predicates: on Parquet they reach the scan as
pushed filters where the column is stored, and otherwise run inside the same
whole-stage-codegen span as the projection.  Missing-value semantics:

* equality filters that *drop* a value keep NULLs (``NOT a <=> v``);
* a NULL outcome is labelled 0, not dropped;
* the final missing-value drop removes NULL **and** NaN (``na.drop``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xgspark.config import (
    BODY_PART_CANDIDATES, CRITICAL_COLUMNS, DEFAULT_COMPETITION_ID, PENALTY_SHOT_TYPE,
    PLAYER_CANDIDATES, SHOOTOUT_PERIOD, SHOT_OUTCOME_CANDIDATES, SHOT_TYPE_CANDIDATES,
    SHOT_TYPE_NAME, TEAM_CANDIDATES,
)
from xgspark.functions.fields import goal_label, location_xy_variant, name_field
from xgspark.functions.geometry import distance_to_goal, shot_angle


def seasons_of(competitions: DataFrame, competition_id: int = DEFAULT_COMPETITION_ID) -> DataFrame:
    """Seasons of one competition (F1)."""
    return competitions.filter(F.col("competition_id") == F.lit(competition_id))


def only_shots(events: DataFrame) -> DataFrame:
    """Keep shot events (F2); a NULL type is dropped.

    ``type`` may be a record ``{id, name}`` or a flat string.
    """
    dtype = events.schema["type"].dataType
    type_name = F.col("type")["name"] if isinstance(dtype, T.StructType) else F.col("type")
    return events.filter(type_name == F.lit(SHOT_TYPE_NAME))


def with_location_xy(df: DataFrame, location: str = "location") -> DataFrame:
    """Add ``x, y`` parsed from the location.

    The location is parsed exactly once per row.  A one-element ``explode``
    sits between the parse and its uses: filters on ``x``/``y`` (or on
    anything computed from them) cannot be pushed below a Generate, so
    Catalyst cannot inline -- and so repeat -- the parse into each predicate.
    """
    dtype = df.schema[location].dataType
    if isinstance(dtype, T.ArrayType):
        arr = F.col(location)
        return (df.withColumn("x", F.get(arr, 0).try_cast("double"))
                  .withColumn("y", F.get(arr, 1).try_cast("double")))
    parsed = F.col(location) if isinstance(dtype, T.VariantType) else F.try_parse_json(F.col(location))
    v = df.select("*", F.explode(F.array(parsed)).alias("__loc"))
    x, y = location_xy_variant("__loc")
    keep = [c for c in df.columns if c not in ("x", "y")]
    return v.select(*keep, x.alias("x"), y.alias("y"))


def drop_penalties(df: DataFrame, shot_type: str = "shot_type") -> DataFrame:
    """Drop penalties; a NULL shot type is kept."""
    return df.filter(~F.col(shot_type).eqNullSafe(F.lit(PENALTY_SHOT_TYPE)))


def drop_shootout(df: DataFrame, period: str = "period") -> DataFrame:
    """Drop shoot-out attempts; a NULL period is kept."""
    return df.filter(~F.col(period).try_cast("int").eqNullSafe(F.lit(SHOOTOUT_PERIOD)))


def missing_mask(df: DataFrame, cols: Sequence[str]) -> Column:
    """True where any of ``cols`` is NULL or (for floating columns) NaN."""
    cond = F.lit(False)
    for c in cols:
        dtype = df.schema[c].dataType
        miss = F.col(c).isNull()
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(F.col(c))
        cond = cond | miss
    return cond


def drop_missing(df: DataFrame, cols: Sequence[str] = CRITICAL_COLUMNS,
                 metrics_name: str | None = None) -> tuple[DataFrame, object]:
    """Drop rows missing any of ``cols`` (NULL or NaN) and count the drops.

    The count is collected with ``DataFrame.observe`` while the result is
    computed -- no second pass.  Returns ``(df, observation)``; read
    ``observation.get`` after an action on ``df``.
    """
    from pyspark.sql import Observation

    import uuid

    obs = Observation(metrics_name or f"drop_missing-{uuid.uuid4().hex}")
    flagged = df.withColumn("__missing", missing_mask(df, cols))
    observed = flagged.observe(
        obs,
        F.count(F.lit(1)).alias("rows_in"),
        F.sum(F.col("__missing").cast("long")).alias("rows_dropped"),
    )
    return observed.filter(~F.col("__missing")).drop("__missing"), obs


def drop_missing_plain(df: DataFrame, cols: Sequence[str] = CRITICAL_COLUMNS) -> DataFrame:
    """Same rows as :func:`drop_missing`, without the drop counter."""
    return df.filter(~missing_mask(df, cols))


def _column_or_null(columns, name: str, dtype: str) -> Column:
    if name in columns:
        return F.col(name).try_cast(dtype)
    return F.lit(None).cast(dtype)


def _shot_rows(events: DataFrame) -> tuple[DataFrame, Column, list[Column]]:
    """Every event with its 13 clean-shot columns, and the F3-F5 condition."""
    df = with_location_xy(events)
    schema = df.schema                      # inspected once for every lookup below
    cols = set(schema.names)
    shot_type = name_field(schema, SHOT_TYPE_CANDIDATES)
    keep = (F.col("x").isNotNull() & F.col("y").isNotNull()                      # F3
            & ~shot_type.eqNullSafe(F.lit(PENALTY_SHOT_TYPE)))                   # F4
    if "period" in cols:
        keep = keep & ~F.col("period").try_cast("int").eqNullSafe(F.lit(SHOOTOUT_PERIOD))  # F5
    return df, keep, [
        _column_or_null(cols, "match_id", "bigint").alias("match_id"),
        name_field(schema, PLAYER_CANDIDATES).alias("player_name"),
        name_field(schema, TEAM_CANDIDATES).alias("team_name"),
        _column_or_null(cols, "minute", "int").alias("minute"),
        _column_or_null(cols, "period", "int").alias("period"),
        name_field(schema, BODY_PART_CANDIDATES).alias("body_part"),
        shot_type.alias("shot_type"),
        _column_or_null(cols, "shot_statsbomb_xg", "double").alias("statsbomb_xg"),
        F.col("x"), F.col("y"),
        goal_label(name_field(schema, SHOT_OUTCOME_CANDIDATES)).cast("int").alias("is_goal"),
        distance_to_goal("x", "y").alias("distance_to_goal"),
        shot_angle("x", "y").alias("shot_angle"),
    ]


def flatten_shots(events: DataFrame) -> DataFrame:
    """Raw shot events to the 13-column clean-shots schema.

    Order follows the behaviour reproduced: location first (malformed ->
    dropped), then penalties and shoot-outs are dropped null-safely, the
    outcome is labelled, names are looked up, geometry is added.  Absent
    optional columns become NULL.  No exception can be raised per row:
    every parse is a ``try_*`` expression (F8).
    """
    df, keep, columns = _shot_rows(events)
    return df.filter(keep).select(*columns)


def shot_flags(events: DataFrame) -> DataFrame:
    """Every shot event with its clean-shot columns, ``passes_filters``
    (F3-F5) and ``kept``: true where :func:`clean_shots` would keep the row
    (F3-F6).

    For audits: raw and kept counts come from one pass over the events
    instead of one pass per count.
    """
    df, keep, columns = _shot_rows(events)
    out = df.select(*columns, keep.alias("passes_filters"))                    # F3-F5
    return out.withColumn("kept", F.col("passes_filters") & ~missing_mask(out, CRITICAL_COLUMNS))


def clean_shots(events: DataFrame) -> DataFrame:
    """Shot events to model-ready shots: F2, flatten, then the final
    missing-value drop (run after F3 so a ``"nan"`` coordinate is removed)."""
    return drop_missing_plain(flatten_shots(only_shots(events)))
