"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator group of the inventory.  Each reads the benchmark tables (or views
Spark derives from them), so its work grows with the data.

Doubles compared against the SQL oracle are rounded half-up to 6 decimals
(``r6``) in both engines; 4-decimal response columns use the same rule.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xgspark.functions.scoring import interpret_xg, round_half_up
from xgspark.operators import aggregates, cleaning, folds, joins, metrics, model, sets, validation
from xgspark.plans.etl import build_shots, shots_from_catalogue
from xgspark.plans.scoring import score_batch, score_json
from xgspark.plans.training import train
from xgspark.schemas import MODEL_TABLE_SCHEMA
from xgspark.session import materialize, scratch_path
from xgspark.sources import event_store, model_io, shots_io, tables
from xgspark.sources.open_data import Layout, read_competitions, read_events, read_matches

# --- FIXED VALUES: fixture parameters of the registered queries ---
ETL_COMPETITION_ID = 1
SERVICE_MODEL = {"intercept": -1.0, "coef_distance": -0.1, "coef_angle": 0.03}
# Per-fold models for out-of-fold scoring: (fold, intercept, coef_distance, coef_angle)
FOLD_MODELS = (
    (0, -1.00, -0.100, 0.030),
    (1, -0.95, -0.105, 0.031),
    (2, -1.05, -0.095, 0.029),
    (3, -0.90, -0.110, 0.032),
    (4, -1.10, -0.090, 0.028),
)


def r6(c) -> F.Column:
    return round_half_up(c, 6)


def _errors_json(df: DataFrame) -> DataFrame:
    return df.withColumn("errors_json", F.to_json("errors")).drop("errors")


def _folded_shots(spark, sf_dir) -> DataFrame:
    return folds.group_kfold(tables.shots_view(spark, sf_dir))


def _scored_shots(spark, sf_dir) -> DataFrame:
    return _folded_shots(spark, sf_dir).withColumn("p", tables.fixture_probability())


def _fold_model_table(spark) -> DataFrame:
    rows = [(f, b1, b2, b0, ["distance_to_goal", "shot_angle"], 0) for f, b0, b1, b2 in FOLD_MODELS]
    return spark.createDataFrame(rows, MODEL_TABLE_SCHEMA)


# --------------------------------------------------------------------------- queries

def q_shot_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, X2 over every shot."""
    s = tables.shots_view(spark, sf_dir)
    return s.select("shot_id", "match_id", "x", "y",
                    r6("distance_to_goal").alias("distance_to_goal"),
                    r6("shot_angle").alias("shot_angle"))


def q_shot_summary(spark, sf_dir) -> DataFrame:
    """A1, A2."""
    s = aggregates.shot_summary(tables.shots_view(spark, sf_dir))
    return s.select("shots", "goals", r6("conversion_rate").alias("conversion_rate"), "matches")


def _clean_out(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("distance_to_goal", "shot_angle")],
                     r6("distance_to_goal").alias("distance_to_goal"),
                     r6("shot_angle").alias("shot_angle"))


def q_clean_shots(spark, sf_dir) -> DataFrame:
    """P1-P4, F2-F6, F8, X1, X2 over the raw shot-shaped events."""
    return _clean_out(cleaning.clean_shots(tables.raw_events_view(spark, sf_dir)))


def q_null_safe_filters(spark, sf_dir) -> DataFrame:
    """NULL shot type / period are kept."""
    raw = tables.raw_events_view(spark, sf_dir)
    kept = cleaning.drop_shootout(cleaning.drop_penalties(raw))
    return kept.select("event_id", "shot_type", "period")


def q_bad_locations(spark, sf_dir) -> DataFrame:
    """Parsed coordinates and validity of every location."""
    raw = cleaning.with_location_xy(tables.raw_events_view(spark, sf_dir))
    return raw.select("event_id", "location", "x", "y",
                      (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("valid"))


def _etl(spark, sf_dir):
    return shots_from_catalogue(tables.competitions_view(spark, sf_dir),
                                tables.matches_view(spark, sf_dir),
                                tables.raw_events_view(spark, sf_dir),
                                ETL_COMPETITION_ID)


def q_missing_value_counts(spark, sf_dir) -> DataFrame:
    """rows reaching the final missing-value drop, and rows it removes
    (NULL or NaN in x, y, is_goal, distance_to_goal)."""
    flat = cleaning.flatten_shots(cleaning.only_shots(tables.raw_events_view(spark, sf_dir)))
    miss = cleaning.missing_mask(flat, ("x", "y", "is_goal", "distance_to_goal"))
    return flat.agg(F.count(F.lit(1)).alias("rows_in"),
                    F.count(F.when(miss, 1)).alias("rows_dropped"))


def q_assembled_features(spark, sf_dir) -> DataFrame:
    """P5: feature vector in trained order, label and group, by name."""
    from pyspark.ml.functions import vector_to_array

    a = model.assemble(tables.shots_view(spark, sf_dir))
    v = vector_to_array("features")
    return a.select(r6(v[0]).alias("f_distance_to_goal"), r6(v[1]).alias("f_shot_angle"),
                    F.col("is_goal").alias("label"), "match_id")


def q_etl_shots(spark, sf_dir) -> DataFrame:
    """E1 over the catalogue views: F1, J1, U2, J2, F2, clean."""
    return _clean_out(_etl(spark, sf_dir).shots)


def q_ingest_audit(spark, sf_dir) -> DataFrame:
    """A3 (with J2, J3 inside)."""
    return _etl(spark, sf_dir).audit


def q_season_matches(spark, sf_dir) -> DataFrame:
    """F1 + J1: matches of one competition tagged with their season name."""
    seasons = cleaning.seasons_of(tables.competitions_view(spark, sf_dir), ETL_COMPETITION_ID)
    return joins.attach_season(tables.matches_view(spark, sf_dir), seasons) \
                .select("match_id", "season_id", "season_name")


def q_matches_without_shots(spark, sf_dir) -> DataFrame:
    """Matches of the competition with no shot event."""
    m = q_season_matches(spark, sf_dir)
    shots = cleaning.only_shots(tables.raw_events_view(spark, sf_dir))
    return joins.matches_without_shots(m, shots).select("match_id", "season_id", "season_name")


def q_distinct_match_ids(spark, sf_dir) -> DataFrame:
    """Distinct match ids that have shot events."""
    shots = cleaning.only_shots(tables.raw_events_view(spark, sf_dir))
    return sets.distinct_ids(shots, "match_id")


def q_ragged_union(spark, sf_dir) -> DataFrame:
    """Two event slices with different columns, unioned by name."""
    e = tables.read_table(spark, sf_dir, "events")
    a = e.filter(F.col("event_type").isin("purchase", "click")) \
         .select("event_id", F.col("user_id").alias("match_id"), "value")
    b = e.filter(~F.col("event_type").isin("purchase", "click") | F.col("event_type").isNull()) \
         .select("event_id", F.col("user_id").alias("match_id"), "props")
    return sets.union_ragged([a, b]).select("event_id", "match_id", "value", "props")


def q_validate_requests(spark, sf_dir) -> DataFrame:
    """V1, V3, V5 on typed requests (strict contract)."""
    v = validation.validate_shots(tables.requests_view(spark, sf_dir), "strict")
    return _errors_json(v).select("request_id", "distance_meters", "angle_degrees", "status",
                                  "errors_json")


def _json_validated(spark, sf_dir, mode):
    v = validation.validate_json(tables.json_requests_view(spark, sf_dir), "body", mode)
    return _errors_json(v).select("request_id", "body", "distance_meters", "angle_degrees",
                                  "status", "errors_json")


def q_validate_json_requests(spark, sf_dir) -> DataFrame:
    """V2, V3 on raw JSON bodies, strict (gateway) contract."""
    return _json_validated(spark, sf_dir, "strict")


def q_validate_json_requests_lax(spark, sf_dir) -> DataFrame:
    """V2, V3 on raw JSON bodies, lax (service) contract."""
    return _json_validated(spark, sf_dir, "lax")


def q_valid_json_requests(spark, sf_dir) -> DataFrame:
    """V4: both sides of the split, with the detail map of the rejected."""
    v = validation.validate_json(tables.json_requests_view(spark, sf_dir), "body", "strict")
    ok, bad = validation.split_valid(v)
    cols = ["request_id", "distance_meters", "angle_degrees"]
    return ok.select(*cols, F.lit("valid").alias("side"), F.lit(None).cast("string").alias("errors_json")) \
             .unionByName(_errors_json(bad).select(*cols, F.lit("rejected").alias("side"), "errors_json"))


def _score_out(df: DataFrame) -> DataFrame:
    return _errors_json(df).select("request_id", "distance_meters", "angle_degrees", "status",
                                   "http_status", "gateway_status", "error", "errors_json", "xg_probability",
                                   "distance_yards", "interpretation")


def q_score_requests(spark, sf_dir) -> DataFrame:
    """X3, X4, X5, P6, V1, V5 with the service model."""
    return _score_out(score_batch(tables.requests_view(spark, sf_dir), SERVICE_MODEL))


def q_score_json_requests(spark, sf_dir) -> DataFrame:
    """V2 + E3: raw JSON bodies validated by the gateway contract, then scored."""
    return _score_out(score_json(tables.json_requests_view(spark, sf_dir), SERVICE_MODEL))


def q_score_requests_no_model(spark, sf_dir) -> DataFrame:
    """A missing model table marks valid rows ``model_unavailable``."""
    missing = model_io.load_model(spark, scratch_path(spark, "no-model"), on_missing="mark")
    return _score_out(score_batch(tables.requests_view(spark, sf_dir), missing))


def q_interpretation_buckets(spark, sf_dir) -> DataFrame:
    """X5 over the fixture model's shot probabilities."""
    s = tables.shots_view(spark, sf_dir).withColumn("p", tables.fixture_probability())
    return s.groupBy(interpret_xg(F.col("p")).alias("interpretation")) \
            .agg(F.count(F.lit(1)).alias("shots"), F.sum("is_goal").cast("long").alias("goals"))


def q_group_kfold_greedy(spark, sf_dir) -> DataFrame:
    """Greedy balanced fold per match."""
    return folds.fold_map(tables.shots_view(spark, sf_dir), "match_id", 5, "greedy") \
                .select("match_id", "n", "fold")


def q_fold_sizes(spark, sf_dir) -> DataFrame:
    """A4 (J4 inside)."""
    return folds.fold_sizes(_folded_shots(spark, sf_dir))


def q_leakage_check(spark, sf_dir) -> DataFrame:
    """No match in two folds."""
    return folds.assert_no_leakage(_folded_shots(spark, sf_dir))


def _metrics_out(df: DataFrame) -> DataFrame:
    return df.select("fold", "n", "goals", r6("log_loss").alias("log_loss"),
                     r6("roc_auc").alias("roc_auc"), r6("brier").alias("brier"))


def q_fold_metrics(spark, sf_dir) -> DataFrame:
    """M1-M4 per fold for the fixture model."""
    return _metrics_out(metrics.fold_metrics(_scored_shots(spark, sf_dir)))


def q_cv_summary(spark, sf_dir) -> DataFrame:
    """A5 over the per-fold metrics."""
    s = metrics.cv_summary(metrics.fold_metrics(_scored_shots(spark, sf_dir)))
    return s.select("folds", *[r6(c).alias(c) for c in s.columns if c != "folds"])


def q_oof_scores(spark, sf_dir) -> DataFrame:
    """Each shot scored by its fold's model (fixed model table)."""
    o = model.score_oof(_folded_shots(spark, sf_dir), _fold_model_table(spark))
    return o.select("shot_id", "match_id", "fold", r6("p").alias("p"))


# Fits run until they agree with the exact optimum to well below the compared digits.
FIT = {"tol": 1e-10, "max_iter": 400}


def r4(c) -> F.Column:
    return round_half_up(c, 4)


def q_fit_folds(spark, sf_dir) -> DataFrame:
    """One MLlib fit per fold."""
    m = model.fit_folds(_folded_shots(spark, sf_dir), **FIT)
    return m.select("fold", r4("coef_distance").alias("coef_distance"), r4("coef_angle").alias("coef_angle"),
                    r4("intercept").alias("intercept"), "n_train")


def gappy_shots_view(spark, sf_dir) -> DataFrame:
    """Shots of which some lack an angle (NULL or NaN): F7 must drop them."""
    angle = F.when(F.col("shot_id") % 101 == 0, F.lit(None).cast("double")) \
             .when(F.col("shot_id") % 103 == 0, F.lit(float("nan"))).otherwise(F.col("shot_angle"))
    return tables.shots_view(spark, sf_dir).withColumn("shot_angle", angle)


def q_train_cv_metrics(spark, sf_dir) -> DataFrame:
    """E2 as one run (F7, G1-G4, U3, M1-M4): per-fold metrics of the
    out-of-fold scores of the fitted fold models."""
    m = train(gappy_shots_view(spark, sf_dir), **FIT).fold_metrics
    return m.select("fold", "n", "goals", r4("log_loss").alias("log_loss"),
                    r4("roc_auc").alias("roc_auc"), r4("brier").alias("brier"))


def q_train_report(spark, sf_dir) -> DataFrame:
    """E2 as one run: rows dropped (F7) and used, matches, the saved and
    reloaded final model (G5, S7, S8)."""
    path = scratch_path(spark, "trained-model")
    rep = train(gappy_shots_view(spark, sf_dir), path, **FIT)
    return model_io.load_model(spark, path).select(
        F.lit(rep.rows_dropped).cast("bigint").alias("rows_dropped"), F.lit(rep.n_rows).cast("bigint").alias("n_rows"),
        F.lit(rep.n_groups).cast("bigint").alias("n_groups"), r4("coef_distance").alias("coef_distance"),
        r4("coef_angle").alias("coef_angle"), r4("intercept").alias("intercept"))


def q_final_model(spark, sf_dir) -> DataFrame:
    """Final fit, coefficients by name."""
    m = model.coefficients(model.fit_final(tables.shots_view(spark, sf_dir), **FIT))
    return m.select("term", r4("value").alias("value"))


# The files that the open-data queries write: JSON lines, one folder per match or season.
WRITTEN_LAYOUT = Layout(competitions="competitions", matches="matches/season_id=*/*.json",
                        events="events/match_id=*/*.json", event_files="events/match_id={match_ids}/*.json",
                        season_id=r"season_id=(\d+)/", match_id=r"match_id=(\d+)/", multi_line=False)


# Events of one match go to files of at most about this many: a match with a
# third of the table is many files, not one task.
EVENTS_PER_FILE = 50_000


def _event_rows(spark, sf_dir) -> DataFrame:
    """What the event records are made of: these narrow rows are dealt to the files."""
    return tables.read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("match_id"),
                                                             "event_type", "value")


def _event_records(rows: DataFrame) -> DataFrame:
    raw = rows.withColumnRenamed("match_id", "user_id").selectExpr("file", *tables.RAW_EVENT_EXPRS)
    shot = F.struct(F.struct(F.lit(0).alias("id"), F.col("shot_outcome").alias("name")).alias("outcome"),
                    F.col("shot_body_part").alias("body_part"), F.col("shot_statsbomb_xg").alias("statsbomb_xg"))
    return raw.select("file", "event_id", "match_id", "type", "period", "minute", F.try_parse_json("location").alias("location"),
                      "player", "team_name", "team", "shot_type", shot.alias("shot"))


# Files that one task writes, about.
FILES_PER_TASK = 500


def _write_lines(rows: DataFrame, files: int, folder: str,
                 to_lines: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """One file for each ``key=value`` folder (the first column) and ``file``
    number, of the ``line`` texts; ``files``: how many there are.  ``to_lines``
    makes the lines of the rows after these are dealt, so that texts, which
    are many times wider, are neither shuffled nor sorted.

    Written by the tasks through Arrow's file systems: Spark's writer commits
    folder by folder on the driver and, on a local disk, starts two processes
    for each file, which takes longer than all else here."""
    key, name, target = rows.columns[0], f"{uuid.uuid4().hex}.json", _arrow_uri(folder)

    def write(batches):
        import os

        import numpy as np
        import pyarrow.types as pt
        from pyarrow import compute, fs

        system, base = fs.FileSystem.from_uri(target)
        current, out = None, None
        for batch in batches:
            values, numbers, text = batch.columns
            _, at, data = text.buffers()
            at = np.frombuffer(at, np.int64 if pt.is_large_string(text.type) else np.int32)[text.offset:]
            # Lines of one file stand together: each run of them is written as the piece of the batch that it is.
            ends = {e for column in (values, numbers) for e in compute.run_end_encode(column).run_ends.to_pylist()}
            begin = 0
            for end in sorted(ends):
                value, number = values[begin].as_py(), numbers[begin].as_py()
                if (value, number) != current:
                    if out is not None:
                        out.close()
                    current, folder = (value, number), f"{base}/{key}={value}"
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(os.path.join(folder, f"part-{number:05d}-{name}"))
                out.write(data.slice(int(at[begin]), int(at[end] - at[begin])))
                begin = end
        if out is not None:
            out.close()
        yield from ()

    dealt = rows.repartition(max(1, -(-files // FILES_PER_TASK)), key, "file").sortWithinPartitions(key, "file")
    lines = to_lines(dealt).select(key, "file", F.concat("line", F.lit("\n")).alias("line"))
    lines.mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()


def _arrow_uri(path: str) -> str:
    """``file:/a b`` and ``/a b`` as Arrow writes them: ``file:///a%20b``."""
    return quote(re.sub("^(file:)?/+", "file:///", path), safe="/:@")


def _delete_folders(keys: DataFrame, folder: str) -> None:
    key, target = keys.columns[0], _arrow_uri(folder)

    def delete(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(target)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                at = f"{base}/{key}={value}"
                if system.get_file_info(at).type != fs.FileType.NotFound:
                    system.delete_dir(at)
        yield from ()

    keys.mapInArrow(delete, "done int").write.format("noop").mode("overwrite").save()


def _write_events(rows: DataFrame, root: str, replace: bool = False,
                  to_records: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """JSON lines, one folder a match (``replace``: in place of what the folder
    held), of the records that ``to_records`` makes of the rows."""
    files = rows.filter("match_id is not null").groupBy("match_id").agg(
        F.ceil(F.count(F.lit(1)) / EVENTS_PER_FILE).alias("files"))
    files = materialize(files, "match-files")
    if replace:
        _delete_folders(files.select("match_id").repartition(4 * files.sparkSession.sparkContext.defaultParallelism),
                        f"{root}/events")
    dealt = rows.join(files, "match_id").withColumn("file", F.pmod(F.xxhash64("event_id"), F.col("files"))).drop("files")

    def to_lines(dealt: DataFrame) -> DataFrame:
        records = to_records(dealt)
        fields = F.struct(*[c for c in records.columns if c not in ("match_id", "event_id", "file")])
        return records.select("match_id", "file", F.to_json(fields).alias("line"))

    _write_lines(dealt, files.agg(F.sum("files")).first()[0] or 0, f"{root}/events", to_lines)


def _open_data(spark, sf_dir, *parts: str) -> str:
    """The catalogue views written as open-data JSON under the shared folder."""
    root = scratch_path(spark, "open-data")
    if "competitions" in parts:
        tables.competitions_view(spark, sf_dir).write.json(f"{root}/competitions")
    if "matches" in parts:
        tables.matches_view(spark, sf_dir).repartition("season_id").write.partitionBy("season_id").json(f"{root}/matches")
    if "events" in parts:
        _write_events(_event_rows(spark, sf_dir), root, to_records=_event_records)
    return root


def q_open_data_competitions(spark, sf_dir) -> DataFrame:
    """The catalogue read from JSON."""
    root = _open_data(spark, sf_dir, "competitions")
    return read_competitions(spark, root, WRITTEN_LAYOUT).select(
        "competition_id", "competition_name", "season_id", "season_name")


def q_open_data_matches(spark, sf_dir) -> DataFrame:
    """Match files of one competition, tagged with their season."""
    root = _open_data(spark, sf_dir, "competitions", "matches")
    seasons = cleaning.seasons_of(read_competitions(spark, root, WRITTEN_LAYOUT), ETL_COMPETITION_ID)
    return read_matches(spark, root, seasons, ETL_COMPETITION_ID, WRITTEN_LAYOUT) \
        .select("match_id", "season_id", "season_name")


def q_open_data_events(spark, sf_dir) -> DataFrame:
    """Every event of every match file, names resolved."""
    root = _open_data(spark, sf_dir, "events")
    e = read_events(spark, root, layout=WRITTEN_LAYOUT)
    return e.select("match_id", F.col("type.name").alias("type_name"), "period", "minute",
                    F.col("player.name").alias("player_name"), F.col("shot_type.name").alias("shot_type"),
                    F.col("shot_outcome.name").alias("outcome"), F.col("shot_body_part.name").alias("body_part"),
                    r6("shot_statsbomb_xg").alias("statsbomb_xg"))


def q_build_shots(spark, sf_dir) -> DataFrame:
    """E1 on files."""
    root = _open_data(spark, sf_dir, "competitions", "matches", "events")
    return _clean_out(build_shots(spark, root, competition_id=ETL_COMPETITION_ID, layout=WRITTEN_LAYOUT).shots)


# Files of any ending: what stands for broken and empty files is written as text.
PLANTED_LAYOUT = replace(WRITTEN_LAYOUT, matches="matches/season_id=*/part-*", events="events/match_id=*/part-*",
                         event_files="events/match_id={match_ids}/part-*")


def _write_text(keys: DataFrame, line: str, path: str) -> None:
    """A file of one line for each key, in the key's folder."""
    keys = materialize(keys.distinct(), "planted-keys")
    _write_lines(keys.select("*", F.lit(0).alias("file"), F.lit(line).alias("line")), keys.count(), path)


def q_event_file_ledger(spark, sf_dir) -> DataFrame:
    """The outcome of every expected season and match file, with
    unreadable, empty and absent files among the written ones."""
    root = _open_data(spark, sf_dir, "competitions")
    matches = tables.matches_view(spark, sf_dir)
    season, match = F.col("season_id") % 5, F.col("match_id") % 19
    matches.filter(~season.isin(2, 3)).repartition("season_id").write.partitionBy("season_id").json(f"{root}/matches")
    _write_text(matches.filter(season == 3).select("season_id"), "{ no json", f"{root}/matches")
    _write_events(_event_rows(spark, sf_dir).filter(~match.isin(3, 5, 7)), root, to_records=_event_records)
    _write_text(matches.filter(match == 3).select("match_id"), "{ no json", f"{root}/events")
    _write_text(matches.filter(match == 5).select("match_id"), " ", f"{root}/events")
    etl = build_shots(spark, root, competition_id=ETL_COMPETITION_ID, layout=PLANTED_LAYOUT,
                      store=scratch_path(spark, "event-store"))
    # A hot match has several files: the ledger has a row for each, here added up.
    return etl.ledger.groupBy("kind", "id", "outcome").agg(F.sum("records").alias("records"),
                                                           F.sum("unreadable").alias("unreadable"))


def q_incremental_ingest(spark, sf_dir) -> DataFrame:
    """S3 in two runs: the second parses new and changed files only; per match
    the events that count and the run that parsed them."""
    root, store = scratch_path(spark, "open-data"), scratch_path(spark, "event-store")
    rows, match = _event_rows(spark, sf_dir), F.col("match_id")
    _write_events(rows.filter(match % 3 != 0), root, to_records=_event_records)
    event_store.sync_events(spark, root, store, layout=WRITTEN_LAYOUT)
    later = ((match % 10 == 1) & (F.col("event_id") % 2 == 0)) | ((match % 10 != 1) & (match % 3 == 0))
    _write_events(rows.filter(later), root, replace=True, to_records=_event_records)
    event_store.sync_events(spark, root, store, layout=WRITTEN_LAYOUT)
    return event_store.read_store(spark, store).groupBy("match_id", "run").agg(F.count(F.lit(1)).alias("events"))


def _build_from_store(spark, sf_dir):
    root = _open_data(spark, sf_dir, "competitions", "matches", "events")
    return build_shots(spark, root, competition_id=ETL_COMPETITION_ID, layout=WRITTEN_LAYOUT,
                       store=scratch_path(spark, "event-store"))


def q_stored_build_shots(spark, sf_dir) -> DataFrame:
    """E1 on stored events."""
    return _clean_out(_build_from_store(spark, sf_dir).shots)


def q_stored_audit(spark, sf_dir) -> DataFrame:
    """A3 from the per-file counts of the store."""
    return _build_from_store(spark, sf_dir).audit


def q_csv_column_orders(spark, sf_dir) -> DataFrame:
    """S6 on files whose columns stand in different orders (one has a column more)."""
    path = scratch_path(spark, "shots-csv-orders")
    src = tables.shots_view(spark, sf_dir)
    halves = [src.filter("shot_id % 2 = 0"), src.filter("shot_id % 2 = 1").select(*reversed(src.columns), F.lit("n").alias("note"))]
    for i, half in enumerate(halves):
        shots_io.write_shots(half, f"{path}/half-{i}", "csv")
    back = shots_io.read_shots(spark, f"{path}/half-*", "csv")
    return back.select(F.col("shot_id").cast("bigint").alias("shot_id"), "match_id", "x", "y",
                       r6("distance_to_goal").alias("distance_to_goal"),
                       r6("shot_angle").alias("shot_angle"), "is_goal", "note")


def q_csv_round_trip(spark, sf_dir) -> DataFrame:
    """Write shots as CSV, read them back with the required-column check."""
    path = scratch_path(spark, "shots-csv")
    src = tables.shots_view(spark, sf_dir)
    shots_io.write_shots(src, path, "csv")
    back = shots_io.read_shots(spark, path, "csv")
    return back.select(F.col("shot_id").cast("bigint").alias("shot_id"), "match_id", "x", "y",
                       r6("distance_to_goal").alias("distance_to_goal"),
                       r6("shot_angle").alias("shot_angle"), "is_goal")


def q_model_round_trip(spark, sf_dir) -> DataFrame:
    """Save the fold model table, load it, score out of fold with it."""
    path = scratch_path(spark, "fold-models")
    model_io.save_model(_fold_model_table(spark), path)
    loaded = model_io.load_model(spark, path)
    o = model.score_oof(_folded_shots(spark, sf_dir), loaded)
    return o.select("shot_id", "match_id", "fold", r6("p").alias("p"))


def q_stream_scores(spark, sf_dir) -> DataFrame:
    """The scoring chain as a Structured Streaming job (availableNow)."""
    from xgspark.streaming.scoring_stream import score_stream_to_table

    out = score_stream_to_table(spark, sf_dir, SERVICE_MODEL)
    return _score_out(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "shot_geometry": q_shot_geometry,
    "shot_summary": q_shot_summary,
    "clean_shots": q_clean_shots,
    "null_safe_filters": q_null_safe_filters,
    "bad_locations": q_bad_locations,
    "missing_value_counts": q_missing_value_counts,
    "assembled_features": q_assembled_features,
    "etl_shots": q_etl_shots,
    "ingest_audit": q_ingest_audit,
    "season_matches": q_season_matches,
    "matches_without_shots": q_matches_without_shots,
    "distinct_match_ids": q_distinct_match_ids,
    "ragged_union": q_ragged_union,
    "validate_requests": q_validate_requests,
    "validate_json_requests": q_validate_json_requests,
    "validate_json_requests_lax": q_validate_json_requests_lax,
    "valid_json_requests": q_valid_json_requests,
    "score_requests": q_score_requests,
    "score_requests_no_model": q_score_requests_no_model,
    "score_json_requests": q_score_json_requests,
    "interpretation_buckets": q_interpretation_buckets,
    "group_kfold_greedy": q_group_kfold_greedy,
    "fold_sizes": q_fold_sizes,
    "leakage_check": q_leakage_check,
    "fold_metrics": q_fold_metrics,
    "cv_summary": q_cv_summary,
    "oof_scores": q_oof_scores,
    "fit_folds": q_fit_folds,
    "train_cv_metrics": q_train_cv_metrics,
    "final_model": q_final_model,
    "train_report": q_train_report,
    "open_data_competitions": q_open_data_competitions,
    "open_data_matches": q_open_data_matches,
    "open_data_events": q_open_data_events,
    "build_shots": q_build_shots,
    "event_file_ledger": q_event_file_ledger,
    "incremental_ingest": q_incremental_ingest,
    "stored_build_shots": q_stored_build_shots,
    "stored_audit": q_stored_audit,
    "csv_round_trip": q_csv_round_trip,
    "csv_column_orders": q_csv_column_orders,
    "model_round_trip": q_model_round_trip,
    "stream_scores": q_stream_scores,
}
