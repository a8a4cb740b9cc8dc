"""The implicit joins of the ETL.

Broadcasting is decided by size, never assumed: :func:`broadcast_if_small`
hints a side only when its row count (an upper bound known from the data it
came from, or counted) is below ``max_rows``; otherwise Catalyst / AQE choose
a shuffle join and AQE may still convert it at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sides at or below this many rows may be broadcast (a few MB of keys).
BROADCAST_MAX_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       known_rows: int | None = None) -> DataFrame:
    """Broadcast hint behind a size check.

    ``known_rows`` may carry a bound that is already known (for example a
    catalogue read from one small file); otherwise the side is counted with
    a bounded ``limit(max_rows + 1)`` so the check itself never scans more
    than ``max_rows + 1`` rows.
    """
    n = known_rows if known_rows is not None else df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def attach_season(matches: DataFrame, seasons: DataFrame) -> DataFrame:
    """Matches of the chosen seasons, tagged with ``season_name``.

    No hint: the season list of one competition is a catalogue read from a
    small file, so Catalyst's size estimate already plans a broadcast, and
    AQE re-checks the materialised size at run time before broadcasting
    (``spark.sql.adaptive.autoBroadcastJoinThreshold``); a large list falls
    back to a shuffle join without a pre-counting job.
    """
    return matches.join(seasons.select("season_id", "season_name"), "season_id", "inner")


def events_of_matches(events: DataFrame, matches: DataFrame, key: str = "match_id",
                      known_rows: int | None = None) -> DataFrame:
    """Events whose match is in ``matches`` (J2, left semi join).

    The id list of a competition is small next to the events: it is
    broadcast after a bounded count (at most ``BROADCAST_MAX_ROWS + 1`` ids
    are counted), so the events are never shuffled for this join.  A larger
    list falls back to a shuffle join (AQE splits a hot match on the events
    side).
    """
    ids = matches.select(key).filter(F.col(key).isNotNull())
    return events.join(broadcast_if_small(ids, known_rows=known_rows), key, "left_semi")


def matches_without_shots(matches: DataFrame, shots: DataFrame, key: str = "match_id") -> DataFrame:
    """Matches that produced no shot (J3, left anti join)."""
    return matches.join(shots.select(key), key, "left_anti")
