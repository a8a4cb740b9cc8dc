"""Raw events to clean, featured shots."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from xgspark.config import DEFAULT_COMPETITION_ID
from xgspark.operators.aggregates import audit_of_counts, ingest_audit
from xgspark.operators.cleaning import clean_shots, only_shots, seasons_of, shot_flags
from xgspark.operators.joins import attach_season, events_of_matches
from xgspark.operators.sets import distinct_ids
from xgspark.session import materialize, materialize_counted
from xgspark.sources.event_store import (
    current_files, file_ledger, list_files, read_store, store_counts, sync_events,
)
from xgspark.sources.open_data import (
    DEFAULT_LAYOUT, Layout, NoDataError, match_records, read_competitions, read_events, read_matches,
)
from xgspark.sources.shots_io import write_shots


@dataclass
class EtlResult:
    shots: DataFrame
    audit: DataFrame
    ledger: DataFrame | None = None       # with a store: one row for each expected file


def shots_from_catalogue(competitions: DataFrame, matches: DataFrame, events: DataFrame,
                         competition_id: int) -> EtlResult:
    """The ETL plan over already-read inputs.

    F1 seasons -> J1 matches with season -> U2 distinct ids -> J2 events of
    those matches -> F2 shots -> clean (P1-P4, F3-F6, X1, X2) ; A3 audit.
    Lazy, but for the match ids, which are written once.
    """
    seasons = seasons_of(competitions, competition_id)
    if "season_name" not in matches.columns:
        matches = attach_season(matches, seasons)
    ids, count = materialize_counted(distinct_ids(matches, "match_id"), "match-ids")
    raw = only_shots(events_of_matches(events, ids, known_rows=count))
    return EtlResult(clean_shots(raw), ingest_audit(ids, raw))


def build_shots(spark: SparkSession, root: str, out: str | None = None,
                competition_id: int = DEFAULT_COMPETITION_ID, fmt: str = "parquet",
                layout: Layout = DEFAULT_LAYOUT, store: str | None = None) -> EtlResult:
    """Open-data files to the clean-shots table.

    Stops with :class:`NoDataError` when there are no matches, no shots, or
    no valid shots.  The match ids are written once; the event files are
    parsed once, into the flagged shots that the clean table and the audit
    read.  The audit also counts ``seasons_without_matches`` and
    ``event_files_skipped`` (unreadable event files).

    With a ``store`` (:mod:`xgspark.sources.event_store`) only event files that
    are new or changed since its last run are parsed, shots are read from the
    stored events, the audit comes from its per-file counts, and ``ledger``
    tells the outcome of every expected match and event file.
    """
    if store:
        return _build_from_store(spark, root, store, out, competition_id, fmt, layout)
    seasons = materialize(seasons_of(read_competitions(spark, root, layout), competition_id), "seasons")
    matches, n_matches = materialize_counted(read_matches(spark, root, seasons, competition_id, layout), "matches")
    if not n_matches:
        raise NoDataError(f"no matches for competition {competition_id}")
    ids = materialize(distinct_ids(matches, "match_id"), "match-ids")
    skipped = Observation(f"skipped-{uuid.uuid4().hex}")
    flags = materialize(shot_flags(only_shots(read_events(spark, root, ids, layout, skipped))), "shot-flags")
    shots = flags.filter(F.col("kept")).drop("kept", "passes_filters")
    if shots.isEmpty():
        raise NoDataError("no valid shots after cleaning")
    without = seasons.join(matches, "season_id", "left_anti").select("season_id").distinct().count()
    audit = ingest_audit(ids, flags=flags).select(
        "*", F.lit(without).cast("bigint").alias("seasons_without_matches"),
        F.lit(int(skipped.get["event_files_skipped"])).cast("bigint").alias("event_files_skipped"))
    if out:
        write_shots(shots, out, fmt)
    return EtlResult(shots, audit)


def _build_from_store(spark: SparkSession, root: str, store: str, out: str | None, competition_id: int, fmt: str,
                      layout: Layout) -> EtlResult:
    seasons = materialize(seasons_of(read_competitions(spark, root, layout), competition_id), "seasons")
    records = materialize(match_records(spark, root, competition_id, layout), "match-records")
    matches = attach_season(records.filter("match_id is not null").select("match_id", "season_id"), seasons)
    ids, n_ids = materialize_counted(distinct_ids(matches, "match_id"), "match-ids")
    if not n_ids:
        raise NoDataError(f"no matches for competition {competition_id}")
    sync_events(spark, root, store, ids, layout)
    shots = clean_shots(read_store(spark, store, ids))
    if shots.isEmpty():
        raise NoDataError("no valid shots after cleaning")
    files = events_of_matches(current_files(spark, store), ids, known_rows=n_ids)
    ledger = materialize(season_ledger(spark, root, seasons, records, competition_id, layout).unionByName(
        file_ledger(ids, files).select(F.lit("events").alias("kind"), F.col("match_id").alias("id"), "file", "outcome",
                                       "records", "unreadable")), "file-ledger")
    counts = ledger.agg(
        F.count_distinct(F.when((F.col("kind") == "matches") & (F.col("outcome") != "read"), F.col("id"))).alias("w"),
        F.coalesce(F.sum(F.when(F.col("kind") == "events", F.col("unreadable"))), F.lit(0)).alias("s"))
    audit = audit_of_counts(ids, store_counts(spark, store).filter("raw_shots > 0")).crossJoin(F.broadcast(counts)) \
        .withColumnsRenamed({"w": "seasons_without_matches", "s": "event_files_skipped"})       # one row each
    if out:
        write_shots(shots, out, fmt)
    return EtlResult(shots, audit, ledger)


def season_ledger(spark: SparkSession, root: str, seasons: DataFrame, records: DataFrame, competition_id: int,
                  layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Outcome of the match file of every expected season (S2), from the parsed
    ``records`` (:func:`~xgspark.sources.open_data.match_records`)."""
    listed = list_files(spark, f"{root.rstrip('/')}/" + layout.matches.format(competition_id=competition_id))
    counts = records.groupBy("file").agg(F.count("match_id").alias("records"), F.count_if("unreadable").alias("unreadable"))
    files = listed.withColumn("season_id", F.regexp_extract("file", layout.season_id, 1).try_cast("bigint")) \
                  .join(counts, "file", "left").fillna(0, ["records", "unreadable"])
    return file_ledger(seasons, files, "season_id").select(
        F.lit("matches").alias("kind"), F.col("season_id").alias("id"), "file", "outcome", "records", "unreadable")
