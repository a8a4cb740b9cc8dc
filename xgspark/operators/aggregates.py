"""Global aggregates (A1-A3).

Each is a single hash aggregate with partial (map-side) aggregation, so only
one small row per task crosses the shuffle.  ``count_distinct`` is exact
(A2); on very many groups it is planned as two aggregates (by key, then
global) which still partial-aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xgspark.config import GROUP_COLUMN, TARGET_COLUMN


def shot_summary(df: DataFrame, label: str = TARGET_COLUMN, group: str = GROUP_COLUMN) -> DataFrame:
    """Shots, goals, conversion rate (0.0 when empty) and distinct matches (A1, A2)."""
    shots = F.count(F.lit(1))
    goals = F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0).cast("long"))
    return df.agg(
        shots.alias("shots"),
        goals.alias("goals"),
        F.coalesce(F.try_divide(goals.cast("double"), shots.cast("double")), F.lit(0.0)).alias("conversion_rate"),
        F.count_distinct(F.col(group)).alias("matches"),
    )


def ingest_audit(matches: DataFrame, raw_shots: DataFrame | None = None, group: str = GROUP_COLUMN,
                 flags: DataFrame | None = None) -> DataFrame:
    """One-row ingest audit (A3, with J2/J3 inside).

    matches total / with shots / without shots, raw shots, kept shots,
    dropped shots (all reasons), dropped for missing critical values (F6),
    goals.  ``matches`` holds distinct ids; ``raw_shots`` are
    the shot events of those matches.  The events are read once: each shot
    is flagged kept or dropped by the cleaning rules, one partial-aggregated
    ``groupBy(match)`` counts both, and a left join to the match ids tells
    matches with and without shots apart.
    """
    from xgspark.operators.cleaning import shot_flags

    if flags is None:               # else: precomputed shot_flags (e.g. a written table)
        flags = shot_flags(raw_shots)
    kept = F.col("kept")
    per_match = flags.groupBy(group).agg(
        F.count(F.lit(1)).alias("raw_shots"),
        F.count(F.when(kept, 1)).alias("kept_shots"),
        F.count(F.when(F.col("passes_filters") & ~kept, 1)).alias("dropped_missing"),
        F.sum(F.when(kept, F.col(TARGET_COLUMN)).cast("long")).alias("goals"))
    return audit_of_counts(matches, per_match, group)


def audit_of_counts(matches: DataFrame, per_match: DataFrame, group: str = GROUP_COLUMN) -> DataFrame:
    """The audit from per-match counts of the matches that have shots."""
    joined = matches.select(group).join(per_match, group, "left")
    zero = F.lit(0).cast("long")
    out = joined.agg(
        F.count(F.lit(1)).alias("matches_total"),
        F.count(F.col("raw_shots")).alias("matches_with_shots"),
        F.count(F.when(F.col("raw_shots").isNull(), 1)).alias("matches_without_shots"),
        F.coalesce(F.sum("raw_shots"), zero).alias("raw_shots"),
        F.coalesce(F.sum("kept_shots"), zero).alias("kept_shots"),
        F.coalesce(F.sum("dropped_missing"), zero).alias("dropped_missing"),
        F.coalesce(F.sum("goals"), zero).alias("goals"),
    )
    return out.select("matches_total", "matches_with_shots", "matches_without_shots",
                      "raw_shots", "kept_shots",
                      (F.col("raw_shots") - F.col("kept_shots")).alias("dropped_shots"),
                      "dropped_missing", "goals")
