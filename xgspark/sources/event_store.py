"""Parsed events kept between runs: incremental ingest, a per-file ledger, and
a read path for the ETL (S2-S4, J2, A3, G1).

A store is a folder::

    <store>/events/run=<n>     events parsed in run n (Parquet, sorted by match)
    <store>/files/run=<n>      one row a file: parsed in run n, or gone since then
    <store>/commits/run=<n>    written last: the run counts

:func:`sync_events` lists the JSON files (names, lengths, times: no content),
parses those that are new or changed and records the ones that are gone, so a
file is parsed once, whatever the number of runs.  A run that dies is not
committed and is done over under the same number.  Per-file counts (events,
shots, kept shots, goals) are taken from what was just written, so the audit,
the group sizes and the ledger read one row a file and never the events.

Scale: no shuffle of events.  The driver holds the names of a folder's entries,
and what Spark knows of the files of a bounded number of them.  Reading joins
the events with the current files of the chosen matches (one row a file, hashes,
broadcast behind a count); up to ``MAX_PUSHED_IDS`` matches also go into the
Parquet scan as a filter, which skips row groups, as the rows of every file are
sorted by match.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xgspark.config import TARGET_COLUMN
from xgspark.operators.cleaning import only_shots, shot_flags
from xgspark.operators.joins import broadcast_if_small, events_of_matches
from xgspark.schemas import EVENTS_SCHEMA
from xgspark.session import (
    few_listing_tasks, materialize, materialize_counted, path_exists, qualified_path, scratch_path,
)
from xgspark.sources.open_data import (
    DEFAULT_LAYOUT, Layout, event_columns, events_path, file_id, literal_paths, read_json,
)

# Up to this many new files are read by name in one scan.  More are read by name in
# several scans, unless one scan can hold all listed files and most of them are new:
# then the folder is read again and a semi join on the file keeps the new ones.  The
# rows are the same.
MAX_NAMED_FILES = 5_000                               # 0: never by name
SCANS_NAMED = 2                                       # a scan of several names this many times as many
LISTED_AT_ONCE = 8_000                                # entries of a folder that the driver lists the files of
LISTED_PER_TASK, PARSED_PER_TASK = 5_000, 1_000
PARSED_BYTES_PER_TASK = 128 << 20
MAX_PUSHED_IDS = 2_000

FILES_SCHEMA = ("file string, path string, size long, modified timestamp, match_id long, records long, "
                "unreadable long, raw_shots long, kept_shots long, dropped_missing long, goals long, "
                "removed boolean, run int")


LISTED_SCHEMA = "file string, path string, size long, modified timestamp"


@dataclass
class Sync:
    """What one run did: its number (0: nothing to do) and its files."""

    run: int
    parsed: int
    removed: int


def _folder(pattern: str) -> str | None:
    """The folder above the first wildcard, if the wildcards are ``*`` and ``?``
    only: it is listed as a whole, in parallel.  A glob is walked by the driver,
    a folder at a time, and each file it names is then looked up again."""
    parts = pattern.split("/")
    first = next((i for i, part in enumerate(parts) if set(part) & set("*?[]{}\\")), 0)
    return "/".join(parts[:first]) if first and not set("/".join(parts[first:])) & set("[]{}\\") else None


def _tasks(spark: SparkSession, files: int, per_task: int, size: int = 0) -> int:
    """Tasks for a scan of many small files: Spark's own splits hold a few dozen."""
    return max(4 * spark.sparkContext.defaultParallelism, files // per_task, size // PARSED_BYTES_PER_TASK)


def _glob_regex(pattern: str) -> str:
    """Of a pattern whose wildcards are ``*`` and ``?`` only."""
    return re.escape(pattern).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")


def _hidden(name: str) -> bool:
    """Whether Spark leaves a folder's entry out of a listing."""
    return (name.startswith((".", "_")) and not (name.startswith("_") and "=" in name) or name.endswith("._COPYING_")) \
        and not name.startswith(("_common_metadata", "_metadata"))


def _names(spark: SparkSession, folder: str) -> Iterator[list[str]]:
    """Names of a folder's entries, up to ``LISTED_AT_ONCE`` at a time."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file" and os.path.isdir(local := path.toUri().getPath()):
        with os.scandir(local) as entries:            # the names alone: Hadoop makes a status of each, all at once
            while names := [e.name for e in islice(entries, LISTED_AT_ONCE)]:
                yield names
        return
    entries = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(system.listStatus(path))
    for at in range(0, len(entries), LISTED_AT_ONCE):
        count = min(LISTED_AT_ONCE, len(entries) - at)
        some = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, count)
        jvm.java.lang.System.arraycopy(entries, at, some, 0, count)
        yield [p.rpartition("/")[2] for p in jvm.org.apache.commons.lang3.StringUtils.join(some, "\0").split("\0")]


def _pieces(spark: SparkSession, folder: str, glob: str) -> Iterator[list[str]]:
    """The folder itself if it has few entries, or else the paths of the entries
    that the glob names, ``LISTED_AT_ONCE`` of the entries at a time: an index of
    Spark's holds some kB a file on the driver, which keeps the names only."""
    if not path_exists(spark, folder):
        return
    named, pieces, count = re.compile(_glob_regex(glob)), [], 0
    for names in _names(spark, folder):
        count += len(names)
        pieces.append("\0".join(n for n in names if named.fullmatch(n) and not _hidden(n)))
    if count <= LISTED_AT_ONCE:
        yield [folder]
        return
    for names in filter(None, pieces):
        yield [f"{folder}/{name}" for name in names.split("\0")]


def _list(spark: SparkSession, paths: list[str], recursive: bool, out: str) -> bool:
    """Append the files at the paths (``recursive``: or below; else the path is a
    glob) to the listing in ``out``; False if there is nothing at any of them.  A
    scan leaves empty files out: if there are any, they are added from the index
    that it was planned with, with the time 0."""
    while True:
        try:
            with few_listing_tasks(spark):
                found = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
                              .load(literal_paths(paths) if recursive else paths))
            break
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            # Some are gone since the folder was listed.
            left = [p for p in paths if path_exists(spark, p)] if recursive else []
            if not left:
                return False
            if len(left) == len(paths):
                raise
            paths = left
    indexed = len(found._jdf.inputFiles())
    there = found.select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size"),
                         F.col("modificationTime").alias("modified"))
    part, n_listed = materialize_counted(there.coalesce(_tasks(spark, indexed, LISTED_PER_TASK)), "listing",
                                         f"{out}/{uuid.uuid4().hex}")
    if n_listed < indexed:
        names = spark.createDataFrame([(n, unquote(n)) for n in found.inputFiles()], "file string, path string")
        plain = F.regexp_replace("file", "^([a-z0-9]+):/+", "$1:/")   # file:/a and file:///a are one file
        empty = names.withColumn("key", plain).join(part.select(F.regexp_replace(
            "file", "^([a-z0-9]+):/+", "$1:/").alias("key")), "key", "left_anti")
        empty = empty.select("file", "path", F.lit(0).cast("long").alias("size"),
                             F.timestamp_seconds(F.lit(0)).alias("modified"))
        empty.write.parquet(f"{out}/{uuid.uuid4().hex}")
    return True


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``file, path, size, modified`` of the files a pattern names, listed once
    (files in folders that Spark hides, ``_x`` or ``.x``, do not count); no
    content is read.  A large folder is listed some of its entries at a time."""
    folder, out = _folder(pattern), scratch_path(spark, "listing")
    below = pattern[len(folder) + 1:] if folder is not None else ""
    pieces = [[pattern]] if folder is None else _pieces(spark, folder, below.split("/")[0])
    if not sum(_list(spark, paths, folder is not None, out) for paths in pieces):
        return spark.createDataFrame([], LISTED_SCHEMA)
    listed = spark.read.schema(LISTED_SCHEMA).option("recursiveFileLookup", True).parquet(out)
    if folder is None:
        return listed
    depth = qualified_path(spark, folder).rstrip("/").count("/")       # of "scheme:/a/b", so without a host's "//"
    at = F.array_join(F.slice(F.split(F.regexp_replace("path", "^([a-z0-9]+):///", "$1:/"), "/"), depth + 2, 1_000), "/")
    return listed.filter(at.rlike(f"^{_glob_regex(below)}(/[^/]+)?$"))


def committed_runs(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the finished runs (one small row a run)."""
    if not path_exists(spark, f"{store}/commits"):
        return []
    rows = spark.read.schema("parsed long, removed long, run int").parquet(f"{store}/commits").select("run").collect()
    return sorted(r["run"] for r in rows)


def current_files(spark: SparkSession, store: str) -> DataFrame:
    """One row for each file whose events count, as its latest run saw it."""
    runs = committed_runs(spark, store)
    if not runs:
        return spark.createDataFrame([], FILES_SCHEMA)
    rows = spark.read.schema(FILES_SCHEMA).parquet(f"{store}/files").filter(F.col("run").isin(runs))
    latest = rows.groupBy("file").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "file"]), "run").alias("f"))
    return latest.select("file", "f.*").filter(~F.col("removed"))


def _scans(new: DataFrame, count: int, listed: int) -> list[tuple[DataFrame, int, bool]]:
    """The new files in the parts that one scan reads: files, their number (about),
    whether they are read by name."""
    if count <= MAX_NAMED_FILES:
        return [(new, count, True)]
    most = SCANS_NAMED * MAX_NAMED_FILES
    if not MAX_NAMED_FILES or 2 * count > listed and listed <= most:
        return [(new, count, False)]
    n = -(-count // most)
    part = F.pmod(F.xxhash64("file"), F.lit(n))
    return [(new.filter(part == i), -(-count // n), True) for i in range(n)]


def _parse(spark: SparkSession, new: DataFrame, count: int, pattern: str, layout: Layout, named: bool) -> DataFrame:
    if named:
        chosen = new.select("path", "size").collect()
        size = sum(r["size"] for r in chosen)
        raw = read_json(spark, EVENTS_SCHEMA, [r["path"] for r in chosen], layout)
    else:
        folder = _folder(pattern)
        raw = read_json(spark, EVENTS_SCHEMA, folder or pattern, layout, recursive=folder is not None)
        # No new file is older than this: older ones are left out of the listing, unopened.
        oldest, size = new.filter("size > 0").agg(F.min(F.unix_micros("modified")), F.sum("size")).first()
        if oldest is not None:
            raw = raw.filter(F.col("_metadata.file_modification_time") >= F.timestamp_micros(F.lit(oldest)))
    raw = raw.withColumn("match_id", file_id(layout.match_id)).withColumn("file", F.col("_metadata.file_path"))
    parsed = raw.select("file", *event_columns())
    if not named:
        parsed = parsed.join(broadcast_if_small(new.select("file"), known_rows=count), "file", "left_semi")
    return parsed.coalesce(_tasks(spark, count, PARSED_PER_TASK, size or 0))


def _counts(events: DataFrame) -> DataFrame:
    """Per-file counts of one run's events; partial sums in every task."""
    records = events.groupBy("file").agg(F.count_if(~F.col("unreadable")).alias("records"),
                                         F.count_if("unreadable").alias("unreadable"))
    shots = only_shots(events.filter(~F.col("unreadable")))
    # The flags keep the clean columns only; the match id stands for nothing else here, so it carries the file.
    by_file = shot_flags(shots.withColumn("match_id", F.xxhash64("file")))
    kept = F.col("kept")
    flags = by_file.groupBy(F.col("match_id").alias("file_key")).agg(
        F.count(F.lit(1)).alias("raw_shots"), F.count_if(kept).alias("kept_shots"),
        F.count_if(F.col("passes_filters") & ~kept).alias("dropped_missing"),
        F.sum(F.when(kept, F.col(TARGET_COLUMN)).cast("long")).alias("goals"))
    return records.join(flags, F.xxhash64("file") == F.col("file_key"), "left").drop("file_key")


def sync_events(spark: SparkSession, root: str, store: str, match_ids: DataFrame | None = None,
                layout: Layout = DEFAULT_LAYOUT) -> Sync:
    """Bring a store up to date with the event files under ``root`` (of the
    chosen matches, or all): new and changed files are parsed, rows of changed
    and vanished ones no longer count."""
    store = store.rstrip("/")
    pattern = events_path(root, match_ids, layout)
    pattern = pattern or f"{root.rstrip('/')}/{layout.events}"
    listed = list_files(spark, pattern)
    listed = listed.withColumn("match_id", F.regexp_extract("file", layout.match_id, 1).try_cast("bigint"))
    n_listed = listed.count()
    known = current_files(spark, store)
    if match_ids is not None:
        listed, known = (events_of_matches(t, match_ids) for t in (listed, known))
    listed = materialize(listed, "listed-files")
    seen = known.select("file", "size", "modified")
    new = materialize(listed.join(seen, ["file", "size", "modified"], "left_anti"), "new-files")
    gone = materialize(known.join(listed, "file", "left_anti"), "gone-files")
    n_new, n_gone = new.count(), gone.count()
    if not n_new and not n_gone:
        return Sync(0, 0, 0)
    run = max(committed_runs(spark, store), default=0) + 1
    counts = None
    if n_new:
        for i, (files, count, named) in enumerate(_scans(new, n_new, n_listed)):
            _parse(spark, files, count, pattern, layout, named).sortWithinPartitions("match_id") \
                .write.mode("append" if i else "overwrite").parquet(f"{store}/events/run={run}")
        counts = _counts(spark.read.parquet(f"{store}/events/run={run}"))
    zero = [c for c in ("records", "unreadable", "raw_shots", "kept_shots", "dropped_missing", "goals")]
    rows = gone.withColumn("removed", F.lit(True)).drop("run")
    if counts is not None:
        seen_now = new.join(counts, "file", "left").fillna(0, zero).withColumn("removed", F.lit(False))
        rows = rows.unionByName(seen_now, allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{store}/files/run={run}")
    spark.createDataFrame([(n_new, n_gone)], "parsed long, removed long").coalesce(1) \
         .write.mode("overwrite").parquet(f"{store}/commits/run={run}")
    return Sync(run, n_new, n_gone)


def read_store(spark: SparkSession, store: str, match_ids: DataFrame | None = None) -> DataFrame:
    """The events that count, as :func:`open_data.read_events` returns them,
    plus the ``run`` that parsed them."""
    store = store.rstrip("/")
    runs = committed_runs(spark, store)
    files = current_files(spark, store)
    with_events = [n for n in runs if path_exists(spark, f"{store}/events/run={n}")]
    if not with_events:
        empty = spark.createDataFrame([], EVENTS_SCHEMA).withColumn("match_id", F.lit(None).cast("bigint"))
        return empty.select(*event_columns()).drop("unreadable").withColumn("run", F.lit(None).cast("int"))
    events = spark.read.option("basePath", f"{store}/events").parquet(*[f"{store}/events/run={n}" for n in with_events])
    if match_ids is not None:
        ids = match_ids.select(F.col("match_id").cast("bigint").alias("match_id")).filter("match_id is not null").distinct()
        few = ids.limit(MAX_PUSHED_IDS + 1).collect()
        if len(few) <= MAX_PUSHED_IDS:
            events = events.filter(F.col("match_id").isin([r["match_id"] for r in few]))
        else:
            files = events_of_matches(files, ids)          # a file is of one match: the events need no join with the ids
    # Two hashes (128 bits) stand for the name, which is many times longer: this side may be broadcast.
    key = [F.xxhash64("file").alias("file_1"), F.xxhash64(F.lit(1), "file").alias("file_2")]
    latest = broadcast_if_small(files.select(*key, F.col("run").cast("int").alias("run")))
    return events.select("*", *key).join(latest, ["file_1", "file_2", "run"], "left_semi") \
        .filter(~F.col("unreadable")).drop("unreadable", "file", "file_1", "file_2")


def store_counts(spark: SparkSession, store: str) -> DataFrame:
    """Per-match counts from the files table (G1's group sizes, A3's parts):
    ``match_id, records, raw_shots, kept_shots, dropped_missing, goals``."""
    sums = [F.sum(c).alias(c) for c in ("records", "raw_shots", "kept_shots", "dropped_missing", "goals")]
    return current_files(spark, store).groupBy("match_id").agg(*sums)


def file_ledger(expected: DataFrame, files: DataFrame, key: str = "match_id") -> DataFrame:
    """One row for each file of the expected ids, or one without a file:
    ``key, file, outcome, records, unreadable``.

    ``outcome`` is ``read`` (some record), ``corrupt`` (no record, some
    unreadable document), ``empty`` (neither) or ``missing`` (no file).
    """
    known = files.select(key, "file", "records", "unreadable")
    outcome = (F.when(F.col("file").isNull(), "missing").when(F.col("records") > 0, "read")
                .when(F.col("unreadable") > 0, "corrupt").otherwise("empty"))
    return (expected.select(key).filter(F.col(key).isNotNull()).distinct().join(known, key, "left")
                    .select(key, "file", outcome.alias("outcome"), F.coalesce("records", F.lit(0)).alias("records"),
                            F.coalesce("unreadable", F.lit(0)).alias("unreadable")))

