from pyspark.sql import functions as F

from xgspark.session import checkpoint_dir, materialize_counted, scratch_path


def test_materialize_cuts_lineage_into_the_checkpoint_folder(spark):
    base = checkpoint_dir(spark)
    df = spark.range(100).withColumn("sq", F.col("id") * F.col("id")).filter("id % 2 = 0")
    out, n = materialize_counted(df, "t")
    assert n == 50 and out.count() == 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan
    path_part = base.split(":", 1)[-1].lstrip("/")          # file:/x and file:///x are the same
    assert out.inputFiles() and all(path_part in f for f in out.inputFiles())


def test_scratch_paths_are_unique_and_inside_the_checkpoint_folder(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(checkpoint_dir(spark)) and b.startswith(checkpoint_dir(spark))


def test_no_shared_folder_is_an_error_on_a_cluster():
    import pytest

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_clear_scratch_deletes_what_was_written(spark):
    import os

    from xgspark.session import clear_scratch, materialize

    path = materialize(spark.range(10), "gone").inputFiles()[0].split(":", 1)[-1]
    assert os.path.exists("/" + path.lstrip("/"))
    assert clear_scratch(spark) >= 1
    assert not os.path.exists("/" + path.lstrip("/"))
