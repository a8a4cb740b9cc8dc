import os
import shutil

import pytest

from tests.conftest import SF_SMALL
from xgspark.plans.scoring import score_batch
from xgspark.sources.tables import REQUEST_EXPRS, read_table, requests_view
from xgspark.streaming.scoring_stream import (
    committed_batches, read_scores, score_stream, score_stream_to_table, scored_schema, write_batch,
)

MODEL = {"intercept": -1.0, "coef_distance": -0.1, "coef_angle": 0.03}


def _requests_stream(spark, src):
    e = spark.readStream.schema("event_id bigint").option("maxFilesPerTrigger", 1).parquet(src)
    return e.selectExpr(*REQUEST_EXPRS)


def test_multi_batch_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    src = str(tmp_path / "events")
    read_table(spark, SF_SMALL, "events").select("event_id").repartition(4).write.parquet(src)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = score_stream(_requests_stream(spark, src), MODEL, out, ckpt)
    q.awaitTermination()
    batches = sorted(os.listdir(out))
    assert len([b for b in batches if b.startswith("batch=")]) >= 4
    cols = ["request_id", "status", "xg_probability", "distance_yards", "interpretation"]

    def streamed():
        return spark.read.parquet(out).select(*cols)

    expected = score_batch(requests_view(spark, SF_SMALL), MODEL).select(*cols)
    got = streamed()
    assert got.count() == expected.count()
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    # restart on the same checkpoint: no new input, no new or changed output
    q2 = score_stream(_requests_stream(spark, src), MODEL, out, ckpt)
    q2.awaitTermination()
    assert streamed().count() == expected.count()


def test_json_body_stream_equals_batch(spark, tmp_path):
    from xgspark.plans.scoring import score_json
    from xgspark.sources.tables import json_requests_view

    src = str(tmp_path / "bodies")
    json_requests_view(spark, SF_SMALL).repartition(3).write.parquet(src)
    stream = spark.readStream.schema("request_id bigint, body string").option("maxFilesPerTrigger", 1).parquet(src)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    score_stream(stream, MODEL, out, ckpt, json_col="body").awaitTermination()
    cols = ["request_id", "status", "gateway_status", "xg_probability", "interpretation"]
    got = spark.read.parquet(out).select(*cols)
    want = score_json(json_requests_view(spark, SF_SMALL), MODEL).select(*cols)
    assert got.count() == want.count() == 1000
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_processing_time_trigger(spark, tmp_path):
    src = str(tmp_path / "events")
    read_table(spark, SF_SMALL, "events").select("event_id").write.parquet(src)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = score_stream(_requests_stream(spark, src), MODEL, out, ckpt, available_now=False)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(out).count() == 1000


@pytest.mark.parametrize("folder", [False, True])
def test_stream_over_a_file_or_a_folder_table(spark, tmp_path, folder):
    sf = tmp_path / "sf"
    sf.mkdir()
    if folder:
        read_table(spark, SF_SMALL, "events").select("event_id").repartition(3).write.parquet(str(sf / "events.parquet"))
    else:
        os.symlink(f"{SF_SMALL}/events.parquet", sf / "events.parquet")
    got = score_stream_to_table(spark, str(sf), MODEL)
    want = score_batch(requests_view(spark, SF_SMALL), MODEL)
    cols = ["request_id", "status", "xg_probability"]
    assert got.count() == 1000
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_stream_over_an_empty_table_is_an_empty_table(spark, tmp_path):
    sf = tmp_path / "sf"
    sf.mkdir()
    read_table(spark, SF_SMALL, "events").limit(0).write.parquet(str(sf / "events.parquet"))
    got = score_stream_to_table(spark, str(sf), MODEL)
    want = score_batch(requests_view(spark, SF_SMALL), MODEL)
    assert got.count() == 0 and dict(got.dtypes) == dict(want.dtypes)


def test_only_committed_batches_are_read_and_a_replay_counts_once(spark, tmp_path):
    src = str(tmp_path / "events")
    read_table(spark, SF_SMALL, "events").select("event_id").repartition(3).write.parquet(src)
    out = str(tmp_path / "out")
    stream = _requests_stream(spark, src)
    score_stream(stream, MODEL, out, str(tmp_path / "ckpt")).awaitTermination()
    schema = scored_schema(stream.schema, spark, MODEL)
    before = sorted(map(str, read_scores(spark, out, schema).collect()))
    assert len(before) == 1000 and committed_batches(spark, out).agg({"rows": "sum"}).first()[0] == 1000
    # Batch 1 again, as after a failure between the write and the offset log.
    again = read_scores(spark, out, schema).filter("batch = 1").select("request_id", "distance_meters", "angle_degrees")
    again = spark.createDataFrame(again.collect(), again.schema)
    batch = score_batch(again, MODEL)
    write_batch(batch, 1, out)
    assert sorted(map(str, read_scores(spark, out, schema).collect())) == before
    # A writer that dies before the commit: what it left is not read.
    write_batch(batch, 7, out)
    assert read_scores(spark, out, schema).count() == 1000 + batch.count()
    shutil.rmtree(os.path.join(out, "_commits", "batch=7"))
    assert sorted(map(str, read_scores(spark, out, schema).collect())) == before
    # An empty batch is a batch with no rows.
    write_batch(batch.limit(0), 8, out)
    assert {r.batch: r.rows for r in committed_batches(spark, out).collect()}[8] == 0
    assert read_scores(spark, out, schema).count() == 1000
