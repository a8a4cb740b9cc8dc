import json
import os

import pytest
from pyspark.sql import functions as F

from tests.test_open_data import _shot, open_data  # noqa: F401
from xgspark.operators.cleaning import clean_shots
from xgspark.plans.etl import build_shots
from xgspark.sources import event_store
from xgspark.sources.event_store import (
    Sync, committed_runs, current_files, file_ledger, read_store, store_counts, sync_events,
)
from xgspark.sources.open_data import read_events


def rows(df):
    shown = df.withColumn("location", F.to_json("location")) if "location" in df.columns else df
    return sorted(map(str, shown.drop("run").collect()))


@pytest.fixture()
def store(tmp_path):
    return str(tmp_path / "store")


def _write(root, match, shots):
    path = os.path.join(root, "events", f"{match}.json")
    with open(path, "w") as f:
        f.write(shots if isinstance(shots, str) else json.dumps(shots))


def test_stored_events_equal_those_of_the_files(spark, open_data, store):  # noqa: F811
    assert sync_events(spark, open_data, store) == Sync(1, 4, 0)
    assert rows(read_store(spark, store)) == rows(read_events(spark, open_data))
    assert rows(clean_shots(read_store(spark, store))) == rows(clean_shots(read_events(spark, open_data)))
    one = spark.createDataFrame([(100,), (None,)], "match_id long")
    assert rows(read_store(spark, store, one)) == rows(read_events(spark, open_data, one))


def test_second_run_parses_new_and_changed_files_only(spark, open_data, store, monkeypatch):  # noqa: F811
    sync_events(spark, open_data, store)
    assert sync_events(spark, open_data, store) == Sync(0, 0, 0)
    _write(open_data, 101, [_shot([91.0, 20.0]), _shot([92.0, 21.0])])           # changed
    _write(open_data, 201, [_shot([93.0, 22.0])])                                # new
    os.remove(os.path.join(open_data, "events", "300.json"))                     # gone
    read = []
    parse = event_store.read_json
    monkeypatch.setattr(event_store, "read_json", lambda s, schema, paths, layout: read.extend(paths) or parse(s, schema, paths, layout))
    assert sync_events(spark, open_data, store) == Sync(2, 2, 1)
    assert sorted(os.path.basename(p) for p in read) == ["101.json", "201.json"]
    assert rows(read_store(spark, store)) == rows(read_events(spark, open_data))
    fresh = f"{store}-fresh"
    sync_events(spark, open_data, fresh)
    assert rows(read_store(spark, fresh)) == rows(read_store(spark, store))
    assert rows(store_counts(spark, fresh)) == rows(store_counts(spark, store))
    # Vanished and back again.
    _write(open_data, 300, [_shot([100.0, 40.0])])
    assert sync_events(spark, open_data, store) == Sync(3, 1, 0)
    assert rows(read_store(spark, store)) == rows(read_events(spark, open_data))


def test_many_new_files_are_read_by_the_listing(spark, open_data, store, monkeypatch):  # noqa: F811
    sync_events(spark, open_data, store)
    monkeypatch.setattr(event_store, "MAX_NAMED_FILES", 0)
    monkeypatch.setattr(event_store, "MAX_PUSHED_IDS", 0)
    _write(open_data, 101, [_shot([91.0, 20.0])])
    assert sync_events(spark, open_data, store) == Sync(2, 1, 0)
    assert rows(read_store(spark, store)) == rows(read_events(spark, open_data))
    ids = spark.createDataFrame([(101,)], "match_id long")
    assert rows(read_store(spark, store, ids)) == rows(read_events(spark, open_data, ids))


def test_a_run_without_commit_does_not_count(spark, open_data, store):  # noqa: F811
    sync_events(spark, open_data, store)
    before = rows(read_store(spark, store))
    _write(open_data, 101, [_shot([91.0, 20.0])])
    sync_events(spark, open_data, store)
    after = rows(read_store(spark, store))
    os.rename(f"{store}/commits/run=2", f"{store}-run-2")                        # as if it had died before
    assert committed_runs(spark, store) == [1] and rows(read_store(spark, store)) == before
    assert sync_events(spark, open_data, store) == Sync(2, 1, 0)                 # done over
    assert rows(read_store(spark, store)) == after


def test_ledger_names_every_outcome(spark, open_data, store):  # noqa: F811
    _write(open_data, 102, "[]")
    open(os.path.join(open_data, "events", "103.json"), "w").close()
    sync_events(spark, open_data, store)
    assert sync_events(spark, open_data, store) == Sync(0, 0, 0)
    expected = spark.createDataFrame([(i,) for i in (100, 101, 102, 103, 200, 201, 100, None)], "match_id long")
    got = {r.match_id: (r.outcome, r.records, r.unreadable) for r in file_ledger(expected, current_files(spark, store)).collect()}
    assert got == {100: ("read", 7, 0), 101: ("read", 1, 0), 102: ("empty", 0, 0), 103: ("empty", 0, 0),
                   200: ("corrupt", 0, 1), 201: ("missing", 0, 0)}


def test_etl_from_a_store_equals_the_etl_from_files(spark, open_data, store):  # noqa: F811
    direct, stored = build_shots(spark, open_data), build_shots(spark, open_data, store=store)
    assert rows(stored.shots) == rows(direct.shots)
    assert stored.audit.first().asDict() == direct.audit.first().asDict()
    ledger = {(r.kind, r.id): r.outcome for r in stored.ledger.collect()}
    assert ledger == {("matches", 3): "read", ("matches", 106): "read", ("matches", 999): "corrupt",
                      ("events", 100): "read", ("events", 101): "read", ("events", 200): "corrupt",
                      ("events", 201): "missing"}
    assert "300" not in {r.match_id for r in current_files(spark, store).collect()}     # another competition's
    plan = stored.shots._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(match_id" not in plan and "In(match_id" in plan      # no shuffle of events, ids in the scan
    _write(open_data, 201, [_shot([99.0, 38.0])])
    again = build_shots(spark, open_data, store=store)
    assert rows(again.shots) == rows(build_shots(spark, open_data).shots) and committed_runs(spark, store) == [1, 2]


def test_empty_store_and_no_files(spark, tmp_path, store):
    assert read_store(spark, store).count() == 0 and current_files(spark, store).count() == 0
    assert sync_events(spark, str(tmp_path / "nowhere"), store) == Sync(0, 0, 0)
    assert store_counts(spark, store).count() == 0


def test_a_glob_and_its_folder_list_the_same_files(spark, tmp_path):
    """The folder above the wildcards is listed once; only what the glob names counts."""
    for name in ("events/match_id=1/a.json", "events/match_id=1/b.txt", "events/match_id=1/deep/c.json", "events/d.json",
                 "events/match_id=2/part 1.json", "events/match_id=2/_hidden.json", "events/x/match_id=3/e.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    (tmp_path / "events" / "match_id=2" / "empty.json").write_text("")
    (tmp_path / "events" / "empty.json").write_text("")

    def listed(pattern):
        return sorted((os.path.relpath(r.path.removeprefix("file:").replace("///", "/"), tmp_path), r.size)
                      for r in event_store.list_files(spark, f"{tmp_path}/{pattern}").collect())

    found = [("events/match_id=1/a.json", 2), ("events/match_id=2/empty.json", 0), ("events/match_id=2/part 1.json", 2)]
    assert [(f, n) for f, n in listed("events/match_id=*/*.json") if "part" not in f] == found[:2]
    assert [n for f, n in listed("events/match_id=*/*.json") if "part" in f] == [2]
    assert listed("events/match_id={1,2}/a.json") == found[:1] and listed("events/match_id=?/a.json") == found[:1]
    assert listed("events/*.json") == [("events/d.json", 2), ("events/empty.json", 0)]
    jobs = event_store._folder(f"{tmp_path}/events/match_id=*/*.json")
    assert jobs == f"{tmp_path}/events" and event_store._folder(f"{tmp_path}/events/{{1,2}}.json") is None


def test_older_files_are_not_opened_again(spark, open_data, store, monkeypatch):  # noqa: F811
    """Many new files: those older than every new one are left out of the scan, and listing makes few tasks."""
    sync_events(spark, open_data, store)
    monkeypatch.setattr(event_store, "MAX_NAMED_FILES", 0)
    _write(open_data, 201, [_shot([93.0, 22.0])])
    later = os.path.getmtime(os.path.join(open_data, "events", "100.json")) + 100
    os.utime(os.path.join(open_data, "events", "201.json"), (later, later))
    scans = []
    parse = event_store._parse
    monkeypatch.setattr(event_store, "_parse", lambda *a: scans.append(parse(*a)) or scans[-1])
    assert sync_events(spark, open_data, store) == Sync(2, 1, 0)
    assert "file_modification_time >= " in scans[0]._jdf.queryExecution().executedPlan().toString()
    assert rows(read_store(spark, store)) == rows(read_events(spark, open_data))


def test_planted_files_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """One file a key, whatever the number of tasks; a replaced folder keeps no older file."""
    from xgspark.plans import catalog

    tmp_path = tmp_path / "a b"
    monkeypatch.setattr(catalog, "FILES_PER_TASK", 3)
    monkeypatch.setattr(catalog, "EVENTS_PER_FILE", 2)
    catalog._write_text(spark.range(20).select(F.col("id").alias("match_id")), "{ no json", f"file:{tmp_path}/events")
    files = sorted(p for p in (tmp_path / "events").rglob("*") if p.is_file())
    assert len(files) == 20 and {p.read_text() for p in files} == {"{ no json\n"}
    records = spark.sql("SELECT id AS event_id, id % 3 AS match_id, CAST(NULL AS INT) AS minute, 'é' AS team FROM range(30) "
                        "UNION ALL SELECT 99, NULL, 1, 'x'")
    catalog._write_events(records, str(tmp_path), replace=True)
    lines = {m: [ln for p in (tmp_path / "events" / f"match_id={m}").iterdir() for ln in p.read_text().splitlines()] for m in range(4)}
    assert [lines[m] for m in range(3)] == [['{"team":"é"}'] * 10] * 3 and lines[3] == ["{ no json"]
    assert len(list((tmp_path / "events" / "match_id=0").iterdir())) > 1
    catalog._write_events(records.filter("event_id < 1"), str(tmp_path), replace=True)
    assert len(list((tmp_path / "events" / "match_id=0").iterdir())) == 1


def test_many_new_files_among_more_are_read_by_name(spark, open_data, store, monkeypatch):  # noqa: F811
    """New files that are at most half of those listed are read by name, in several scans; no other file is opened."""
    ids = spark.createDataFrame([(i,) for i in (101, 201, 202, 203, 204, 205)], "match_id long")
    for match in (201, 202, 203, 204, 205, *range(400, 412)):
        _write(open_data, match, [_shot([93.0, 22.0]), _shot([94.0, match - 180.0])])
    monkeypatch.setattr(event_store, "MAX_NAMED_FILES", 1)
    monkeypatch.setattr(event_store, "SCANS_NAMED", 2)
    monkeypatch.setattr(event_store, "events_path", lambda *a: None)            # as with more ids than a glob takes
    scans = []
    parse = event_store.read_json
    monkeypatch.setattr(event_store, "read_json", lambda s, schema, paths, *a, **k: scans.append(paths) or parse(s, schema, paths, *a, **k))
    assert sync_events(spark, open_data, store, ids) == Sync(1, 6, 0)
    assert len(scans) == 3 and sorted(os.path.basename(p) for paths in scans for p in paths) == [
        "101.json", "201.json", "202.json", "203.json", "204.json", "205.json"]
    assert rows(read_store(spark, store)) == rows(read_events(spark, open_data, ids))
    monkeypatch.setattr(event_store, "MAX_PUSHED_IDS", 0)
    some = ids.filter("match_id > 202").union(ids.filter("match_id > 203"))
    assert rows(read_store(spark, store, some)) == rows(read_events(spark, open_data, some)) != []


def test_records_are_made_after_the_rows_are_dealt(spark, tmp_path, monkeypatch):
    """Only narrow rows are shuffled; lines of one file may come in several batches."""
    from xgspark.plans import catalog

    monkeypatch.setattr(catalog, "EVENTS_PER_FILE", 1_000)
    data, dealt = spark.range(60).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("match_id")), []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        catalog._write_events(data, str(tmp_path), to_records=lambda d: dealt.append(d) or d.withColumn("wide", F.concat(F.lit("é"), "event_id")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = dealt[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "wide" not in plan
    for match in range(4):
        (file,) = (tmp_path / "events" / f"match_id={match}").iterdir()
        assert sorted(file.read_text().splitlines()) == sorted(f'{{"wide":"é{i}"}}' for i in range(match, 60, 4))


def test_a_large_folder_is_listed_some_of_its_entries_at_a_time(spark, tmp_path, monkeypatch):
    """No index of Spark's holds the files of more entries than the bound; the listing is the same."""
    for name in ("a.json", "b 1.json", "[c].json", "d{1,2}.json", "é%20.json", "_e.json", ".f.json", "_metadata.json", "g.txt",
                 "h.json/i.json", "h.json/_j.json", "h.json/deep/k.json", "_l.json/m.json", "_n=1.json/o.json"):
        (tmp_path / "events" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "events" / name).write_text("{}")
    (tmp_path / "events" / "empty.json").write_text("")

    def listed(root=tmp_path):
        found = [tuple(map(str, r)) for p in ("*.json", "?.json", "*/*.json", "none*")
                 for r in event_store.list_files(spark, f"{root}/events/{p}").collect()]
        return sorted(found)

    whole, parts, part = listed(), [], event_store._list
    assert [os.path.basename(r[1]) for r in whole].count("i.json") == 3
    monkeypatch.setattr(event_store, "_list", lambda s, paths, *a: parts.append(len(paths)) or part(s, paths, *a))
    monkeypatch.setattr(event_store, "LISTED_AT_ONCE", 3)
    assert listed() == whole and len(parts) > 6 and max(parts) == 3
    # Through a file system that only Spark's readers know.
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.parts.link./in", f"file:{tmp_path}")
    parts.clear()
    assert sorted((os.path.basename(r[0]), r[2:]) for r in listed("viewfs://parts/in")) == sorted((os.path.basename(r[0]), r[2:]) for r in whole)
    assert len(parts) > 6 and max(parts) == 3
    # An entry that goes while the folder is listed is left out.
    monkeypatch.setattr(event_store, "_pieces", lambda *a: iter([[f"{tmp_path}/events/a.json", f"{tmp_path}/events/gone.json"],
                                                                 [f"{tmp_path}/events/gone.json"]]))
    assert [os.path.basename(r.path) for r in event_store.list_files(spark, f"{tmp_path}/events/*.json").collect()] == ["a.json"]


def test_new_files_that_one_scan_cannot_hold_are_read_in_several(spark, open_data, store, monkeypatch):  # noqa: F811
    """Even where all listed files are new, no scan is of many more files than the bound."""
    for match in range(400, 420):
        _write(open_data, match, [_shot([93.0, 22.0]), _shot([94.0, match - 380.0])])
    for name in ("no id.json", "[500].json", "no event.json"):
        with open(os.path.join(open_data, "events", name), "w") as f:
            f.write(json.dumps([_shot([95.0, 23.0])]) if "event" not in name else "")
    monkeypatch.setattr(event_store, "MAX_NAMED_FILES", 2)
    monkeypatch.setattr(event_store, "SCANS_NAMED", 2)
    monkeypatch.setattr(event_store, "LISTED_AT_ONCE", 5)
    scans, parse = [], event_store.read_json
    monkeypatch.setattr(event_store, "read_json", lambda s, schema, paths, *a, **k: scans.append(paths) or parse(s, schema, paths, *a, **k))
    assert sync_events(spark, open_data, store) == Sync(1, 27, 0)
    assert len(scans) == 7 and all(isinstance(paths, list) for paths in scans) and sum(map(len, scans)) == 27
    assert rows(read_store(spark, store)) == rows(read_events(spark, open_data))
    assert read_store(spark, store).filter("match_id IS NULL").count() == 2


def test_file_names_are_not_broadcast(spark, open_data, store):  # noqa: F811
    """The files that count are known by hashes of their names; changed files' older rows do not count."""
    sync_events(spark, open_data, store)
    _write(open_data, 101, [_shot([91.0, 20.0])])
    assert sync_events(spark, open_data, store).parsed == 1
    stored = read_store(spark, store)
    plan = stored._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftSemi" in line)
    assert "rightHint=(strategy=broadcast)" in join and "file#" not in join and "file_1" in join
    assert rows(stored) == rows(read_events(spark, open_data)) and "file_1" not in stored.columns
