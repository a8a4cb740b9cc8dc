"""Readers for the public open-data JSON layout.

The default :class:`Layout`::

    <root>/competitions.json                           array of competition-season rows
    <root>/matches/<competition_id>/<season_id>.json   array of matches
    <root>/events/<match_id>.json                      array of events of one match

Paths, id patterns and the JSON form (one document a file, or one a line) are
fields of the layout.  The per-season and per-match fetch loops become single
multi-file scans; a corrupt file yields no rows and does not fail the job (it
is counted); identifiers missing from payloads come from
``_metadata.file_path``.  For repeated use, keep the parsed events in a store
(:mod:`xgspark.sources.event_store`), or write them once to Parquet
(:func:`compact_events`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xgspark.functions.fields import named_of_variant
from xgspark.operators.joins import attach_season, events_of_matches
from xgspark.schemas import (
    COMPETITIONS_SCHEMA, CORRUPT, EVENT_FLAT_NAMES, EVENTS_SCHEMA, MATCHES_SCHEMA,
)
from xgspark.session import few_listing_tasks


class NoDataError(RuntimeError):
    """A stage produced no rows where the job cannot continue."""


@dataclass(frozen=True)
class Layout:
    """Where the files are, relative to the root, and how ids are found."""

    competitions: str = "competitions.json"
    matches: str = "matches/{competition_id}/*.json"
    events: str = "events/*.json"
    event_files: str | None = "events/{match_ids}.json"   # glob of chosen matches; None: read all
    season_id: str = r"(\d+)\.json$"                      # first group, from the file path
    match_id: str = r"(\d+)\.json$"
    multi_line: bool = True                               # one document a file; False: one a line


DEFAULT_LAYOUT = Layout()


def literal_paths(paths: list[str]) -> list[str]:
    """The names as patterns that name nothing else."""
    return [re.sub(r"([{}\[\]*?\\])", r"\\\1", path) for path in paths]


def read_json(spark: SparkSession, schema: T.StructType, path: str | list[str], layout: Layout,
              recursive: bool = False) -> DataFrame:
    """A scan that keeps every record: a field that does not fit is NULL, and
    an unreadable document is one row of NULLs (dropped by the callers).
    ``recursive``: every file at any depth below the path.  A list is of names,
    not of patterns."""
    from pyspark.errors import AnalysisException

    try:
        with few_listing_tasks(spark):
            return (spark.read.schema(schema)
                         .option("multiLine", layout.multi_line)
                         .option("mode", "PERMISSIVE")
                         .option("columnNameOfCorruptRecord", CORRUPT)
                         .option("ignoreMissingFiles", True)
                         .option("recursiveFileLookup", recursive)
                         .json(path if isinstance(path, str) else literal_paths(path)))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise NoDataError(f"no files under {path}") from e
        raise


def file_id(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("bigint")


def read_competitions(spark: SparkSession, root: str, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Competitions catalogue (S1).  A missing, empty or unreadable catalogue is an error."""
    df = read_json(spark, COMPETITIONS_SCHEMA, f"{root.rstrip('/')}/{layout.competitions}", layout)
    # A catalogue row without its ids is unusable.
    df = df.filter(F.col("competition_id").isNotNull() & F.col("season_id").isNotNull())
    if df.isEmpty():
        raise NoDataError("competitions catalogue is empty or unreadable")
    return df


def match_records(spark: SparkSession, root: str, competition_id: int,
                  layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Every record of the competition's match files, parsed once: ``match_id``,
    ``season_id`` (from the file path), ``file``, ``unreadable``."""
    path = f"{root.rstrip('/')}/" + layout.matches.format(competition_id=competition_id)
    schema = T.StructType([*MATCHES_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    return read_json(spark, schema, path, layout).select(
        "match_id", file_id(layout.season_id).alias("season_id"), F.col("_metadata.file_path").alias("file"),
        (F.col(CORRUPT).isNotNull() & F.col("match_id").isNull()).alias("unreadable"))


def read_matches(spark: SparkSession, root: str, seasons: DataFrame, competition_id: int,
                 layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Matches of the given seasons, tagged with ``season_name``.

    One multi-file scan over the competition's folder; the season id comes
    from the file path.  A corrupt or missing season file is skipped (the
    audit counts seasons without a match).
    """
    path = f"{root.rstrip('/')}/" + layout.matches.format(competition_id=competition_id)
    df = read_json(spark, MATCHES_SCHEMA, path, layout)
    df = (df.filter(F.col("match_id").isNotNull())
            .select(F.col("match_id"), file_id(layout.season_id).alias("season_id")))
    return attach_season(df, seasons)


# Up to this many chosen match ids, only their files are read.  The glob's
# alternation is matched against every listed file name, so it is kept
# short; beyond it one listing plus the semi join is cheaper.  The rows read
# are the same.
MAX_PRUNED_IDS = 2_000


def events_path(root: str, match_ids: DataFrame | None, layout: Layout) -> str | None:
    """Glob of the event files to read; None when no match is chosen.

    With a bounded id list (checked with a bounded count) the glob names
    only those files (``events/{id1,id2,...}.json``), so other matches'
    files are never listed or opened -- file pruning for a layout without
    partition columns.  Absent files simply do not match.  Otherwise every
    file is read and the semi join (J2) keeps the chosen matches.
    """
    base = root.rstrip("/")
    if match_ids is not None and layout.event_files:
        ids = match_ids.select(F.col("match_id").cast("bigint").alias("match_id")) \
                       .filter(F.col("match_id").isNotNull()).distinct().limit(MAX_PRUNED_IDS + 1).collect()
        if not ids:
            return None
        if len(ids) <= MAX_PRUNED_IDS:
            chosen = ",".join(str(v) for v in sorted(r["match_id"] for r in ids))
            return f"{base}/" + layout.event_files.format(match_ids="{" + chosen + "}")
    return f"{base}/{layout.events}"


def _number(v: Column, dtype: str) -> Column:
    return F.try_variant_get(v, "$", dtype)


def read_events(spark: SparkSession, root: str, match_ids: DataFrame | None = None,
                layout: Layout = DEFAULT_LAYOUT, skipped: Observation | None = None) -> DataFrame:
    """Events of the chosen matches with ``match_id`` attached.

    Fields may be flat or nested (``shot.type`` or ``shot_type``; a record or
    a bare value): names come out as ``{id, name}`` records, numbers as
    numbers (numeric text is accepted, other text is NULL), ``location``
    stays VARIANT.  ``skipped`` observes ``event_files_skipped``: unreadable
    documents among the files read.
    """
    path = events_path(root, match_ids, layout)
    if path is None:
        raw = spark.createDataFrame([], EVENTS_SCHEMA).withColumn("match_id", F.lit(None).cast("bigint"))
    else:
        raw = read_json(spark, EVENTS_SCHEMA, path, layout).withColumn("match_id", file_id(layout.match_id))

    df = raw.select(*event_columns())
    if skipped is not None:
        df = df.observe(skipped, F.count_if("unreadable").alias("event_files_skipped"))
    df = df.filter(~F.col("unreadable")).drop("unreadable")
    if match_ids is not None and path is not None:
        df = events_of_matches(df, match_ids)
    return df


def event_columns() -> list[Column]:
    """The columns of an event from a raw record with its ``match_id``;
    ``unreadable`` marks a document that is no JSON."""
    def either(flat: str, nested: str) -> Column:
        return F.coalesce(F.col(flat), F.col(nested))

    return [
        F.col("match_id"), named_of_variant(F.col("type")).alias("type"),
        _number(F.col("period"), "int").alias("period"), _number(F.col("minute"), "int").alias("minute"),
        F.col("location"), named_of_variant(F.col("player")).alias("player"), named_of_variant(F.col("team")).alias("team"),
        named_of_variant(either("shot_type", "shot.type")).alias("shot_type"),
        named_of_variant(either("shot_outcome", "shot.outcome")).alias("shot_outcome"),
        named_of_variant(either("shot_body_part", "shot.body_part")).alias("shot_body_part"),
        _number(either("shot_statsbomb_xg", "shot.statsbomb_xg"), "double").alias("shot_statsbomb_xg"),
        *[F.try_variant_get(F.col(c), "$", "string").alias(c) for c in EVENT_FLAT_NAMES],
        (F.col(CORRUPT).isNotNull() & F.col("type").isNull()).alias("unreadable")]


def compact_events(events: DataFrame, out: str, partition_by: str | None = None) -> None:
    """Write events once to Parquet (optionally partitioned) for repeated use.

    VARIANT columns are stored as Parquet variant; later reads prune columns
    and push filters into the scan.
    """
    w = events.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(out)
