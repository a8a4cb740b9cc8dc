"""Corpus pipeline: documents through five of the operators, in order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's documents.
"""

from pyspark.sql import DataFrame, SparkSession

from xgspark.llm import decontaminate, language_id, mixing, sharding, simhash
from xgspark.session import scratch_path
from xgspark.sources.tables import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with a sufficient margin."""
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: a whole document once
    per copy the mix takes of it, up to the one nearest its source's target."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the shard its id belongs to."""
    return sharding.with_shard(docs, sharding.layout())


STAGES = [
    ("language_id", identify_language),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Compression sizes and fingerprints are not SQL: tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
