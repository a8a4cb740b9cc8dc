"""Grouped k-fold assignment and its checks.

Whole groups go to one fold; folds are balanced by row count: groups are taken
largest first (ties: larger group id first) and each goes to the lightest fold
(ties: lowest fold index).

One plan at every size, and no task or driver ever holds the groups:

* Rows are counted per group (partial aggregates before the shuffle).
* Groups of one size ``n`` form a *run*.  Within a run the greedy rule merges
  the k progressions ``load_f + j * n`` by (value, fold), which is at most k
  cyclic segments.  So the sequential walk needs only the pairs (size, number
  of groups): at most ``sqrt(2 * rows)`` of them, as the sizes are distinct.
* A group's fold follows from its rank in its run, a distributed prefix sum
  over range buckets of (size, id).

``method='hash'`` hashes the group key instead: balanced in expectation only.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xgspark.config import GROUP_COLUMN, N_SPLITS
from xgspark.operators.joins import broadcast_if_small
from xgspark.session import materialize, materialize_counted

log = logging.getLogger(__name__)

# Groups ranked by one task, about.
GROUPS_PER_RANGE = 1_000_000


class FoldError(ValueError):
    """Raised when grouped cross-validation cannot run (too few groups)."""


def effective_folds(n_groups: int, requested: int = N_SPLITS) -> int:
    """``min(requested, n_groups)``; fewer than 2 is an error."""
    k = min(requested, n_groups)
    if k < 2:
        raise FoldError(f"Not enough distinct groups ({n_groups}) for grouped k-fold.")
    if k < requested:
        log.warning("Only %d groups available: reducing folds from %d to %d.",
                    n_groups, requested, k)
    return k


def group_counts(df: DataFrame, group: str = GROUP_COLUMN) -> DataFrame:
    """Rows per group, partial-aggregated before the shuffle."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def run_segments(loads: list[int], n: int, count: int) -> list[tuple[int, list[int]]]:
    """Where ``count`` groups of size ``n`` go, one after the other, each to the
    lightest fold: ``[(first rank, folds in turn), ...]``.  ``loads`` is
    updated.

    The lightest folds take groups in turn until the next fold up joins them;
    between two such joins the turn order does not change.
    """
    waiting = sorted(range(len(loads)), key=lambda f: (loads[f], f))
    active: list[int] = []
    segments: list[tuple[int, list[int]]] = []
    rank = 0
    while rank < count:
        if waiting:
            active.append(waiting.pop(0))
        turn = sorted(active, key=lambda f: (loads[f], f))
        take = count - rank
        if waiting:                                  # groups placed before the next fold joins
            g = waiting[0]
            gap = [loads[g] - loads[f] for f in turn]
            take = min(take, sum(max(0, d // n + 1 if f < g else -(-d // n)) for f, d in zip(turn, gap)))
        if take:
            segments.append((rank, turn))
            for i, f in enumerate(turn):
                loads[f] += n * (take // len(turn) + (i < take % len(turn)))
            rank += take
    return segments


def fold_map(df: DataFrame, group: str = GROUP_COLUMN, k: int = N_SPLITS,
             method: str = "greedy") -> DataFrame:
    """One row per group: ``group, n, fold`` (G1, with G2 applied)."""
    return _fold_map(df, group, k, method)[0]


def _ranked(counts: DataFrame, group: str, n_groups: int) -> DataFrame:
    """``counts`` plus ``__rank``: the rank (from 0) of a group among those of
    its size, larger ids first."""
    ranges = max(1, math.ceil(n_groups / GROUPS_PER_RANGE))
    by_id = F.col(group).desc()
    if ranges == 1:                    # one range: the rank within it is the rank
        return counts.withColumn("__rank", F.row_number().over(Window.partitionBy("n").orderBy(by_id)) - 1)
    # Written once, so that every use sees the same range of each group.
    cut = materialize(counts.repartitionByRange(ranges, F.col("n").desc(), by_id)
                            .withColumn("__range", F.spark_partition_id()), "group-ranges")
    sizes = cut.groupBy("n", "__range").agg(F.count(F.lit(1)).alias("__groups"))
    ahead = Window.partitionBy("n").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("n", "__range", F.coalesce(F.sum("__groups").over(ahead), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__range", "n").orderBy(by_id)
    return (cut.withColumn("__row", F.row_number().over(inside)).join(offsets, ["n", "__range"])
               .select(group, "n", (F.col("__offset") + F.col("__row") - 1).alias("__rank")))


def _greedy_folds(counts: DataFrame, group: str, k: int, n_groups: int) -> DataFrame:
    spark = counts.sparkSession
    runs = counts.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).collect()   # <= sqrt(2 * rows)
    loads, rows = [0] * k, []
    for n, groups in sorted(((r["n"], r["groups"]) for r in runs), reverse=True):
        rows.append((n, [{"start": a, "folds": f} for a, f in run_segments(loads, n, groups)]))
    turns = spark.createDataFrame(rows, "n long, segments array<struct<start: long, folds: array<int>>>")
    segment = F.element_at(F.filter("segments", lambda x: x["start"] <= F.col("__rank")), -1)
    at = F.pmod(F.col("__rank") - F.col("__segment.start"), F.size("__segment.folds"))
    return (_ranked(counts, group, n_groups).join(broadcast_if_small(turns, known_rows=len(rows)), "n")
            .withColumn("__segment", segment)
            .select(group, "n", F.element_at("__segment.folds", (at + 1).cast("int")).alias("fold")))


def _fold_map(df: DataFrame, group: str, k: int, method: str) -> tuple[DataFrame, int]:
    """The fold map and the number of groups."""
    if method not in ("greedy", "hash"):
        raise ValueError(f"unknown fold method {method!r}")
    # One pass over the rows; the per-group counts (one small row per group)
    # are written to the checkpoint folder and read from there afterwards.
    counts, n_groups = materialize_counted(group_counts(df, group), "group-counts")
    kk = effective_folds(n_groups, k)
    if method == "hash":
        return counts.withColumn("fold", F.pmod(F.xxhash64(F.col(group)), F.lit(kk)).cast("int")), n_groups
    # Cheap to recompute from the written counts: not written itself.
    return _greedy_folds(counts, group, kk, n_groups), n_groups


def group_kfold(df: DataFrame, group: str = GROUP_COLUMN, k: int = N_SPLITS,
                method: str = "greedy") -> DataFrame:
    """``df`` plus a ``fold`` column, whole groups per fold (G1 + J4).

    The fold map has one row per group; it is broadcast only when that
    (already counted) number is small, else joined with a shuffle (AQE
    splits a skewed hot group on the large side).  Rows without a group key
    have no fold and are left out.
    """
    fm, n_groups = _fold_map(df, group, k, method)
    return df.join(broadcast_if_small(fm.select(group, "fold"), known_rows=n_groups), group, "inner")


def group_summary(df: DataFrame, group: str = GROUP_COLUMN, fold: str = "fold",
                  label: str | None = None) -> DataFrame:
    """``group, fold, rows`` (and ``pos`` with a label): the one pass over the
    rows that the checks, sizes and class counts below are read from."""
    pos = [] if label is None else [F.sum(F.col(label).cast("long")).alias("pos")]
    return df.groupBy(group, fold).agg(F.count(F.lit(1)).alias("rows"), *pos)


def assert_no_leakage(df: DataFrame, group: str = GROUP_COLUMN, fold: str = "fold") -> DataFrame:
    """One-row check that no group sits in two folds (U3), over the rows or
    their :func:`group_summary`.

    Equivalent to "train groups and test groups are disjoint in every fold",
    for all folds in a single aggregate.  Columns: ``n_groups,
    n_leaking_groups``.
    """
    per_group = df.groupBy(group).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"))
    return per_group.agg(F.count(F.lit(1)).alias("n_groups"),
                         F.count(F.when(F.col("lo") != F.col("hi"), 1)).alias("n_leaking_groups"))


def check_no_leakage(df: DataFrame, group: str = GROUP_COLUMN, fold: str = "fold") -> None:
    """Raise when :func:`assert_no_leakage` finds a group in several folds."""
    row = assert_no_leakage(df, group, fold).first()
    if row["n_leaking_groups"]:
        raise FoldError(f"Data leakage: {row['n_leaking_groups']} groups appear in several folds.")


def fold_sizes(df: DataFrame, group: str = GROUP_COLUMN, fold: str = "fold") -> DataFrame:
    """Per fold: ``train_rows, test_rows, test_matches`` (A4)."""
    return sizes_of_summary(group_summary(df, group, fold), group, fold)


def sizes_of_summary(summary: DataFrame, group: str = GROUP_COLUMN, fold: str = "fold") -> DataFrame:
    """:func:`fold_sizes` from a :func:`group_summary`.

    ``train_rows`` is total minus the fold's rows: a window over the k
    per-fold rows only (never over the data).
    """
    per = summary.groupBy(fold).agg(F.sum("rows").alias("test_rows"),
                                    F.count(F.col(group)).alias("test_matches"))
    total = F.sum("test_rows").over(Window.partitionBy(F.lit(0)))
    return per.select(fold, (total - F.col("test_rows")).alias("train_rows"),
                      "test_rows", "test_matches")
