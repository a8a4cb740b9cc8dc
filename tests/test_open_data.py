import json
import os

import pytest

from xgspark.plans.etl import build_shots
from xgspark.sources.open_data import NoDataError, read_events
from xgspark.sources.shots_io import MissingColumnsError, read_shots, write_shots


def _shot(loc, shot_type="Open Play", outcome="Saved", period=1, player="A", type_name="Shot"):
    return {"type": {"id": 16, "name": type_name}, "period": period, "minute": 12, "location": loc,
            "player": {"id": 1, "name": player}, "team": {"id": 2, "name": "Team"},
            "shot": {"type": {"id": 87, "name": shot_type}, "outcome": {"id": 97, "name": outcome},
                     "body_part": {"id": 40, "name": "Right Foot"}, "statsbomb_xg": 0.12}}


@pytest.fixture()
def open_data(tmp_path):
    root = tmp_path / "open"
    (root / "matches" / "43").mkdir(parents=True)
    (root / "matches" / "11").mkdir(parents=True)
    (root / "events").mkdir(parents=True)
    (root / "competitions.json").write_text(json.dumps([
        {"competition_id": 43, "season_id": 3, "season_name": "2018", "competition_name": "World Cup"},
        {"competition_id": 43, "season_id": 106, "season_name": "2022", "competition_name": "World Cup"},
        {"competition_id": 43, "season_id": 999, "season_name": "broken", "competition_name": "World Cup"},
        {"competition_id": 11, "season_id": 1, "season_name": "other", "competition_name": "Other"},
    ]))
    (root / "matches" / "43" / "3.json").write_text(json.dumps([{"match_id": 100}, {"match_id": 101}]))
    (root / "matches" / "43" / "106.json").write_text(json.dumps([{"match_id": 200}, {"match_id": 201}]))
    (root / "matches" / "43" / "999.json").write_text("{ this is not json")
    (root / "matches" / "11" / "1.json").write_text(json.dumps([{"match_id": 300}]))
    (root / "events" / "100.json").write_text(json.dumps([
        _shot([108.0, 40.0], outcome="Goal"),
        _shot([110.0, 30.0], shot_type="Penalty"),
        _shot([100.0, 40.0], period=5),
        _shot([100.0]),
        _shot(["107.5", 41, 0.3]),
        _shot([105.0, 44.0], player=None),
        _shot([90.0, 20.0], type_name="Pass"),
    ]))
    (root / "events" / "101.json").write_text(json.dumps([_shot([90.0, 20.0], type_name="Pass")]))
    (root / "events" / "200.json").write_text("[{ broken")
    (root / "events" / "300.json").write_text(json.dumps([_shot([100.0, 40.0])]))
    return str(root)


def test_build_shots_end_to_end(spark, open_data, tmp_path):
    out = str(tmp_path / "shots")
    res = build_shots(spark, open_data, out, competition_id=43)
    shots = sorted(res.shots.collect(), key=lambda r: r.x)
    assert [(r.match_id, r.x, r.y) for r in shots] == [(100, 105.0, 44.0), (100, 107.5, 41.0),
                                                        (100, 108.0, 40.0)]
    goal = [r for r in shots if r.x == 108.0][0]
    assert goal.is_goal == 1 and goal.distance_to_goal == 12.0 and goal.shot_type == "Open Play"
    assert goal.body_part == "Right Foot" and goal.statsbomb_xg == 0.12
    assert [r.player_name for r in shots if r.x == 105.0] == [None]
    audit = res.audit.first().asDict()
    assert audit == {"matches_total": 4, "matches_with_shots": 1, "matches_without_shots": 3,
                     "raw_shots": 6, "kept_shots": 3, "dropped_shots": 3, "dropped_missing": 0,
                     "goals": 1, "seasons_without_matches": 1, "event_files_skipped": 1}
    back = read_shots(spark, out)
    assert back.count() == 3


def test_events_carry_match_id_and_variant_location(spark, open_data):
    ev = read_events(spark, open_data)
    ids = sorted({r.match_id for r in ev.select("match_id").collect()})
    assert ids == [100, 101, 300]          # the corrupt file is skipped
    assert ev.schema["location"].dataType.typeName() == "variant"


def test_one_odd_field_never_costs_an_event(spark, tmp_path):
    """Flat and nested shapes, text for numbers, fractions: every event stays,
    whatever columns are read."""
    root = tmp_path / "odd"
    (root / "events").mkdir(parents=True)
    plain = [_shot([100.0 + i, 40.0]) for i in range(3)]
    odd = {1: [*plain[:2], {**_shot([101.0, 40.0]), "minute": "12"}],
           2: [plain[0], {**_shot([102.0, 40.0]), "player": "Flat Player"}],
           3: [plain[0], {**_shot([103.0, 40.0]), "type": "Shot"}],
           4: [plain[0], {**_shot([104.0, 40.0]), "period": 1.0, "minute": "45+2"}],
           5: [plain[0], {"type": "Shot", "period": 1, "minute": 3, "location": [105.0, 40.0],
                          "player_name": "P", "team": "T", "shot_type": "Open Play",
                          "shot_outcome_name": "Goal", "shot_statsbomb_xg": "0.25"}]}
    for m, events in odd.items():
        (root / "events" / f"{m}.json").write_text(json.dumps(events))
    from xgspark.operators.cleaning import clean_shots

    shots = clean_shots(read_events(spark, str(root)))
    rows = shots.collect()
    assert len(rows) == shots.count() == shots.select("match_id").count() == 11
    by = {(r.match_id, r.x): r for r in rows}
    assert by[(1, 101.0)].minute == 12 and by[(2, 102.0)].player_name == "Flat Player"
    assert by[(4, 104.0)].period == 1 and by[(4, 104.0)].minute is None
    last = by[(5, 105.0)]
    assert (last.player_name, last.team_name, last.is_goal, last.statsbomb_xg) == ("P", "T", 1, 0.25)


def test_empty_id_list_reads_nothing(spark, open_data):
    none = spark.createDataFrame([], "match_id long")
    assert read_events(spark, open_data, none).count() == 0


def test_missing_catalogue_is_no_data(spark, tmp_path):
    from xgspark.sources.open_data import read_competitions

    with pytest.raises(NoDataError):
        read_competitions(spark, str(tmp_path / "nowhere"))


def test_no_matches_is_an_error(spark, open_data):
    with pytest.raises(NoDataError):
        build_shots(spark, open_data, None, competition_id=77)


def test_csv_round_trip_and_required_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted" name', 1.5, float("nan"), 1, 10.0, 20.0)],
                               "match_id long, player_name string, x double, y double, is_goal int, "
                               "distance_to_goal double, shot_angle double")
    p = str(tmp_path / "csv")
    write_shots(df, p, "csv")
    text = "".join(open(os.path.join(p, f)).read() for f in sorted(os.listdir(p)) if f.endswith(".csv"))
    assert "NaN" not in text and '""quoted""' in text
    back = read_shots(spark, p, "csv").first()
    assert back.player_name == 'a "quoted" name' and back.y is None and back.x == 1.5
    write_shots(df.drop("shot_angle"), str(tmp_path / "csv2"), "csv")
    with pytest.raises(MissingColumnsError):
        read_shots(spark, str(tmp_path / "csv2"), "csv")


def test_event_files_are_pruned_to_chosen_matches(spark, open_data):
    ids = spark.createDataFrame([(100,), (201,)], "match_id long")   # 201 has no file
    ev = read_events(spark, open_data, ids)
    files = {r.match_id for r in ev.select("match_id").distinct().collect()}
    assert files == {100}
    assert "300.json" not in " ".join(ev.inputFiles())


def test_compacted_events_keep_variant_location(spark, open_data, tmp_path):
    from xgspark.operators.cleaning import clean_shots
    from xgspark.sources.open_data import compact_events

    out = str(tmp_path / "compact")
    compact_events(read_events(spark, open_data), out, partition_by="match_id")
    back = spark.read.parquet(out)
    assert back.schema["location"].dataType.typeName() == "variant"
    direct = sorted((r.match_id, r.x, r.y) for r in clean_shots(read_events(spark, open_data)).collect())
    again = sorted((r.match_id, r.x, r.y) for r in clean_shots(back).collect())
    assert direct == again and len(direct) == 4


def test_csv_hand_over_from_etl_to_training(spark, open_data, tmp_path):
    from tests.conftest import SF_MID
    from xgspark.plans.training import train
    from xgspark.sources.tables import shots_view

    out = str(tmp_path / "shots_csv")
    build_shots(spark, open_data, out, competition_id=43, fmt="csv")
    shots = read_shots(spark, out, "csv")
    assert dict(shots.dtypes)["match_id"] == "bigint" and dict(shots.dtypes)["is_goal"] == "int"
    assert shots.count() == 3
    # the CSV hand-over feeds training: a larger shot table through the same format
    big = str(tmp_path / "big_csv")
    write_shots(shots_view(spark, SF_MID), big, "csv")
    rep = train(read_shots(spark, big, "csv"))
    assert rep.n_rows == 10000 and rep.n_groups == 150
    assert rep.cv_summary.first().folds == 5


def test_no_valid_shots_is_an_error(spark, tmp_path):
    root = tmp_path / "only_penalties"
    (root / "matches" / "43").mkdir(parents=True)
    (root / "events").mkdir(parents=True)
    (root / "competitions.json").write_text(json.dumps(
        [{"competition_id": 43, "season_id": 3, "season_name": "2018", "competition_name": "World Cup"}]))
    (root / "matches" / "43" / "3.json").write_text(json.dumps([{"match_id": 500}]))
    (root / "events" / "500.json").write_text(json.dumps([_shot([110.0, 40.0], shot_type="Penalty"),
                                                          _shot([100.0, 40.0], period=5)]))
    with pytest.raises(NoDataError):
        build_shots(spark, str(root), None, competition_id=43)


def test_csv_files_are_bound_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("match_id,distance_to_goal,shot_angle,is_goal\n1,10.5,20.5,1\n")
    (folder / "part-1.csv").write_text('is_goal,"shot_angle",note,match_id,distance_to_goal\n0,30.5,"a, b",2,40.5\n')
    (folder / "part-2.csv").write_text("")
    (folder / "_SUCCESS").write_text("")
    rows = {r.match_id: r for r in read_shots(spark, str(folder), "csv").collect()}
    assert (rows[1].distance_to_goal, rows[1].shot_angle, rows[1].is_goal, rows[1].note) == (10.5, 20.5, 1, None)
    assert (rows[2].distance_to_goal, rows[2].shot_angle, rows[2].is_goal, rows[2].note) == (40.5, 30.5, 0, "a, b")
    one = read_shots(spark, str(folder / "part-0.csv"), "csv")
    assert one.columns == ["match_id", "distance_to_goal", "shot_angle", "is_goal"] and one.count() == 1
    (folder / "part-3.csv").write_text("match_id,distance_to_goal,is_goal\n1,10.5,1\n")
    with pytest.raises(MissingColumnsError, match="part-3.csv.*shot_angle"):
        read_shots(spark, str(folder), "csv")
    with pytest.raises(MissingColumnsError):
        read_shots(spark, str(tmp_path / "none*"), "csv")
