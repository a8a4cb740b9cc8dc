"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_ragged(dfs: Sequence[DataFrame]) -> DataFrame:
    """Concatenate frames whose columns differ; missing columns become NULL.

    ``unionByName`` is a narrow operation: no shuffle, partitions are appended.
    """
    if not dfs:
        raise ValueError("union_ragged needs at least one DataFrame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-NULL values of one column (U2): partial distinct per task,
    then one shuffle on the key."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct()
