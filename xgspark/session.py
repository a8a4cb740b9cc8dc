"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_scratch: list[str] = []      # intermediate tables written by this process


def build_session(master: str | None = None, app_name: str = "xgspark",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the jobs assume (AQE on, UTC, no UI).

    On a cluster leave ``master`` unset: the launcher decides.  Set
    ``shuffle_partitions`` from the largest shuffle (input bytes / ~128 MB,
    e.g. tens of thousands for 100 TB).  Unset, a shuffle starts with 2,000
    partitions, which AQE merges to about 128 MB each (it never adds any).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A partition holding several times the median is split (a hot match
        # can hold a third of all rows).
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        # Post-shuffle partitions of about 128 MB after AQE coalescing; scan
        # splits of 256 MB keep task counts sane on 100 TB inputs.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoint files of DataFrames that went out of scope are removed.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Broadcasts are explicit and size-checked in code; keep the automatic
        # threshold at its default so Catalyst may still pick small sides.
        "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    }
    if not shuffle_partitions:
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "2000"
    else:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``.  When the session leaves it unset, a
    ``local`` master (tests) gets a fresh folder; any other master raises, as
    executors would not see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    current = sc.getConf().get(_CHECKPOINT_KEY, None)
    if not current:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(f"{_CHECKPOINT_KEY} is not set: name a folder that the driver and "
                               "all executors share")
        current = tempfile.mkdtemp(prefix="xgspark-ckpt-")
    sc.setCheckpointDir(current)
    # setCheckpointDir creates a per-application sub-folder; use that.
    return sc.getCheckpointDir() or current


def materialize(df, name: str = "stage"):
    """Write ``df`` once as a Parquet table in the shared checkpoint folder
    and read it back: the lineage is cut there.

    For small derived tables read several times (group counts, fold maps,
    distinct-score tables): one job computes them, later jobs read columnar
    files with exact size statistics instead of re-running the scan, and a
    lost executor does not replay the upstream work.  The table stays until
    :func:`clear_scratch` (the command-line jobs call it when they end) or
    until the checkpoint folder itself is removed.
    """
    return materialize_counted(df, name)[0]


def materialize_counted(df, name: str = "stage", path: str | None = None):
    """:func:`materialize` that also returns the row count, observed while
    writing (no second job).  ``path``: where to, if not a fresh sub-path."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    obs = Observation(f"rows-{os.path.basename(path)}")     # unique per write
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), int(obs.get["rows"])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the checkpoint folder for one written table
    (unique across threads and processes)."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _scratch.append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system (any that Spark can read)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def qualified_path(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as Spark names the files below it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """Listings of many folders made inside run as a few tasks a core: by default
    each folder is a task of its own, up to 10,000 of them.  Nor are they kept for
    later reads, which list anew anyway: the driver would hold up to 250 MB of them."""
    tasks, kept = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.manageFilesourcePartitions"
    before = {key: spark.conf.get(key) for key in (tasks, kept)}
    spark.conf.set(tasks, str(min(int(before[tasks]), 4 * spark.sparkContext.defaultParallelism)))
    spark.conf.set(kept, "false")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far by this process; returns
    how many there were.  Tables read lazily from them must be consumed first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _scratch:
        path = hadoop(_scratch.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count
