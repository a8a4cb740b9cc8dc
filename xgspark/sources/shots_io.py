"""Clean-shots table persistence."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xgspark.config import FEATURE_COLUMNS, GROUP_COLUMN, TARGET_COLUMN
from xgspark.operators.sets import union_ragged
from xgspark.schemas import CLEAN_SHOTS_SCHEMA

REQUIRED_TRAINING_COLUMNS = (*FEATURE_COLUMNS, TARGET_COLUMN, GROUP_COLUMN)


class MissingColumnsError(ValueError):
    """The shots table lacks columns required downstream."""


def write_shots(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write clean shots, replacing the previous output.

    Parquet is the main format.  CSV is kept for interchange: NaN is written
    as an empty field (not the text ``NaN``) and quotes are doubled.
    """
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        cols = []
        for f in df.schema.fields:
            c = F.col(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
            cols.append(c.alias(f.name))
        (df.select(cols).write.mode("overwrite")
           .option("header", True).option("escape", '"').option("nullValue", "")
           .csv(path))
    else:
        raise ValueError(f"unknown format {fmt!r}")


def csv_headers(spark: SparkSession, path: str, threads: int = 16) -> dict[str, tuple[str, ...]]:
    """File -> column names, for the files that a CSV read of ``path`` (a file,
    a folder or a glob) takes in.  Only the first line of each file is read; an
    empty file has no columns and is left out."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(conf)
    found = []
    for status in fs.globStatus(pattern) or []:
        listed = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath() for s in listed
                  if not s.isDirectory() and s.getLen() and not s.getPath().getName().startswith(("_", "."))]
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(p) -> tuple[str, tuple[str, ...]]:
        stream, codec = fs.open(p), codecs.getCodec(p)
        try:
            line = jvm.org.apache.hadoop.io.Text()
            jvm.org.apache.hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream).readLine(line)
        finally:
            stream.close()
        return p.toString(), tuple(next(csv.reader([line.toString().lstrip("\ufeff")]), ()))

    with ThreadPoolExecutor(max_workers=threads) as pool:
        return {file: header for file, header in pool.map(first_line, found) if header}


def read_shots(spark: SparkSession, path: str, fmt: str = "parquet",
               required: Sequence[str] = REQUIRED_TRAINING_COLUMNS) -> DataFrame:
    """Read clean shots and check the required columns before any action.

    Of a CSV table every file is bound by its own header: files whose columns
    stand in the same order are read together, and the groups are united by
    name (a column that some files lack is NULL there).
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        groups: dict[tuple[str, ...], list[str]] = {}
        for file, header in csv_headers(spark, path).items():
            absent = [c for c in required if c not in header]
            if absent:
                raise MissingColumnsError(f"{file} is missing required columns: {absent}")
            groups.setdefault(header, []).append(file)
        if not groups:
            raise MissingColumnsError(f"no CSV file with a header under {path}")
        # The headers decide which columns exist; types come from the fixed schema.
        typed = {f.name: f.dataType for f in CLEAN_SHOTS_SCHEMA.fields}
        parts = [spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
                      .schema(T.StructType([T.StructField(c, typed.get(c, T.StringType())) for c in header]))
                      .csv(files) for header, files in sorted(groups.items())]
        df = union_ragged(parts)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"shots table is missing required columns: {missing}")
    return df
