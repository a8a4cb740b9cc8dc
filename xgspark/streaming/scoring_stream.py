"""Stream scoring (E4): the always-on scoring service as a Structured
Streaming job.

Stateless: each request is validated and scored on its own, with the same
expression chain as batch scoring (E3), so the two cannot disagree.  The
model is loaded once per query (as literals in the plan).  The sink is
``foreachBatch``: each micro-batch is one write, partitioned by ``status``
(accepted and rejected rows land in folders of their own), under a per-batch
folder that is overwritten on replay, followed by a commit.  Readers use a
declared schema and see committed batches only, so a batch re-run after a
failure counts once (on top of the checkpointed source offsets), a half-written
one not at all, and a stream without input is an empty table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xgspark.operators.joins import broadcast_if_small
from xgspark.plans.scoring import score_batch, score_json
from xgspark.session import scratch_path
from xgspark.sources.tables import REQUEST_EXPRS

# Input files per micro-batch: bounds what one batch reads and rewrites on replay.
FILES_PER_BATCH = 1_000
COMMITS = "_commits"        # folder of the commits beside the batches; no reader lists it as data


def requests_stream_from_events(spark: SparkSession, sf_dir: str,
                                max_files_per_trigger: int = FILES_PER_BATCH) -> DataFrame:
    """Streaming request rows derived from the ``events`` Parquet table, which
    is one file or a folder of part files."""
    return (spark.readStream.schema("event_id bigint")
                 .option("maxFilesPerTrigger", max_files_per_trigger)
                 .parquet(f"{sf_dir.rstrip('/')}/[e]vents.parquet")     # a glob: takes a file or a folder
                 .selectExpr(*REQUEST_EXPRS))


def scored_schema(request_schema: T.StructType, spark: SparkSession, model: dict | None, validate: bool = True,
                  mode: str = "strict", json_col: str | None = None) -> T.StructType:
    """The declared columns of the output for requests of a schema."""
    empty = spark.createDataFrame([], request_schema)
    scored = _scored(empty, model, validate, mode, json_col)
    return T.StructType([*(f for f in scored.schema.fields if f.name != "status"),
                         T.StructField("batch", T.LongType()), T.StructField("status", T.StringType())])


def _scored(requests: DataFrame, model, validate: bool, mode: str, json_col: str | None) -> DataFrame:
    return score_json(requests, model, json_col, mode) if json_col else score_batch(requests, model, validate, mode)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _make_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def write_batch(batch: DataFrame, batch_id: int, out_dir: str) -> None:
    """One micro-batch: its commit (if any) is taken back, its folder is
    replaced, and then it is committed.  Running it again gives the same files;
    stopping anywhere in between leaves a batch that readers do not see."""
    spark = batch.sparkSession
    commit = os.path.join(out_dir, COMMITS, f"batch={batch_id}")
    _remove(spark, commit)
    rows = Observation(f"rows-{uuid.uuid4().hex}")
    batch.observe(rows, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy("status") \
         .parquet(os.path.join(out_dir, f"batch={batch_id}"))
    spark.createDataFrame([(int(rows.get["rows"]),)], "rows long").coalesce(1).write.mode("overwrite").parquet(commit)


def score_stream(stream: DataFrame, model: dict | None, out_dir: str, checkpoint: str,
                 validate: bool = True, mode: str = "strict", available_now: bool = True,
                 json_col: str | None = None):
    """Start the scoring stream; returns the ``StreamingQuery``.

    Typed request rows, or raw JSON bodies in ``json_col`` (validated as the
    gateway does).  Writes ``<out_dir>/batch=<id>/status=<status>`` and a commit
    for every finished batch; read it with :func:`read_scores`.
    """
    for folder in (out_dir, os.path.join(out_dir, COMMITS)):
        _make_folder(stream.sparkSession, folder)       # a stream without any batch is readable too
    w = _scored(stream, model, validate, mode, json_col).writeStream \
        .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, out_dir)) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def committed_batches(spark: SparkSession, out_dir: str) -> DataFrame:
    """``batch, rows`` of the finished batches (one row a batch)."""
    return spark.read.schema("rows long, batch long").parquet(os.path.join(out_dir, COMMITS))


def read_scores(spark: SparkSession, out_dir: str, schema: T.StructType) -> DataFrame:
    """The rows of the committed batches, under the declared schema
    (:func:`scored_schema`): none for a stream that had no input, and nothing
    of a batch that is half written."""
    done = committed_batches(spark, out_dir).select("batch")
    return spark.read.schema(schema).parquet(out_dir).join(broadcast_if_small(done), "batch", "left_semi")


def score_stream_to_table(spark: SparkSession, sf_dir: str, model: dict | None) -> DataFrame:
    """Run the stream over the available input to completion and read the
    written table back as one batch DataFrame."""
    base = scratch_path(spark, "stream-scores")
    out = os.path.join(base, "out")
    requests = requests_stream_from_events(spark, sf_dir)
    q = score_stream(requests, model, out, os.path.join(base, "checkpoint"))
    q.awaitTermination()
    return read_scores(spark, out, scored_schema(requests.schema, spark, model)).drop("batch")
