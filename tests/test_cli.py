import json

from tests.conftest import SF_MID
from tests.test_open_data import open_data  # noqa: F401  (fixture)
from xgspark.__main__ import main
from xgspark.sources.tables import shots_view


def test_cli_etl_train_score(spark, open_data, tmp_path, capsys):  # noqa: F811
    shots = str(tmp_path / "shots")
    assert main(["etl", "--root", open_data, "--out", shots, "--competition", "43"]) == 0
    audit = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert audit["kept_shots"] == 3
    store = ["--store", str(tmp_path / "store")]
    assert main(["etl", "--root", open_data, "--out", shots, "--competition", "43", *store]) == 0
    stored = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    files = stored.pop("files")
    assert stored == audit and files == {"events corrupt": 1, "events missing": 1, "events read": 2,
                                         "matches corrupt": 1, "matches read": 2}
    train_in = str(tmp_path / "train_in")
    shots_view(spark, SF_MID).write.parquet(train_in)
    model = str(tmp_path / "model")
    assert main(["train", "--shots", train_in, "--model-out", model]) == 0
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["folds"] == 5 and summary["coef_distance"] < 0
    assert main(["score", "--model", model, "--distance", "11", "--angle", "37"]) == 0
    r = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert 0 < r["xg_probability"] < 1 and r["distance_yards"] == 12.0297
    assert main(["score", "--model", str(tmp_path / "none"), "--distance", "11", "--angle", "37"]) == 0
    r = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert r["status"] == "model_unavailable" and r["http_status"] == 503
