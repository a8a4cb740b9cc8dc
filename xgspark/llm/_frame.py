"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def once_a_worker(name: str, key: str, build):
    """``build()``, kept in the worker process for the tasks to come: one value
    a ``name``, given up when another ``key`` is asked for."""
    kept = sys.modules.setdefault("_xgspark_kept", types.ModuleType("_xgspark_kept"))
    have, value = getattr(kept, name, (None, None))
    if have != key:
        setattr(kept, name, (None, None))
        value = build()
        setattr(kept, name, (key, value))
    return value


def row_key(doc_id: str, text: str) -> Column:
    """A 64-bit key of a document row (id and text); never null."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def cut_ranges(rows: DataFrame, at: str, ranges: int) -> Column:
    """The number of the range that ``at`` (long) falls in, rising with ``at``.

    The axis is cut at up to 64 quantiles of the rows (one small aggregate) and
    each cell into equal parts, so a few far-off values, such as those that
    stand for null, stretch nothing but their own cell.  Found by a tree of
    comparisons, in generated code.
    """
    cells = max(1, min(64, ranges))
    parts = max(1, ranges // cells)
    shares = ", ".join(f"{i / cells!r}D" for i in range(cells + 1))
    found = rows.agg(F.expr(f"percentile_approx(`{at}`, array({shares}), {200 * cells})").alias("cuts"),
                     F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    bounds = sorted({*(found["cuts"] or []), found["lo"] or 0, found["hi"] or 0})
    if len(bounds) == 1:
        return F.lit(0).cast("bigint")

    def cell(i: int, j: int) -> str:                       # the cells i .. j - 1
        if j - i > 1:
            middle = (i + j) // 2
            return f"if(`{at}` < bigint('{bounds[middle]}'), {cell(i, middle)}, {cell(middle, j)})"
        share = f"{parts / (bounds[i + 1] - bounds[i])!r}D * (cast(`{at}` as double) - {float(bounds[i])!r}D)"
        return f"{i * parts} + least({parts - 1}, cast({share} as int))"

    return F.expr(cell(0, len(bounds) - 1)).cast("bigint")


def as_of(probes: DataFrame, bases: DataFrame, keys: list[str], ranges: int = 4096) -> DataFrame:
    """For each probe, the latest base strictly before it with equal keys.

    Both tables have the key columns (never null), ``at`` (long, order) and
    ``id`` (unique in its table, of one type; a probe may have several keys).  Returns
    ``id, base_id`` (null: none) and the other columns of the probes for every
    probe.  Bases with equal ``at`` are ordered by id; a base at the
    probe's own ``at`` counts when its id is smaller.

    No pairs are formed, and a hot key is no single task: the order axis is cut
    into about ``ranges`` ranges of like many rows (:func:`cut_ranges`); rows are scanned within (key, range), and the
    last base of every range is carried on over the ranges of a key.
    """
    more = [c for c in probes.columns if c not in (*keys, "at", "id")]
    both = probes.select(*keys, "at", "id", F.lit(None).cast(dict(bases.dtypes)["id"]).alias("base"), *more) \
        .unionByName(bases.select(*keys, "at", "id", F.col("id").alias("base")), allowMissingColumns=True) \
        .filter("at is not null")
    both = both.withColumn("range", cut_ranges(both, "at", ranges))
    inside = Window.partitionBy(*keys, "range").orderBy("at", "id", F.col("base").asc_nulls_first())
    scanned = both.withColumn("near", F.last("base", ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, -1)))
    last = both.groupBy(*keys, "range").agg(
        F.max(F.when(F.col("base").isNotNull(), F.struct("at", "base"))).alias("b"))
    ahead = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "range", F.last("b.base", ignorenulls=True).over(ahead).alias("far"))
    return (scanned.filter("base is null").join(carried, [*keys, "range"])
                   .select("id", F.coalesce("near", "far").alias("base_id"), *more))


def position(rows: DataFrame, key: str, at: str, tie: str, ranges: int = 4096) -> DataFrame:
    """All columns plus ``position``: the gapless rank (from 0) of each row of
    a key by ``at`` (long, not null), then ``tie``; ranked within ranges of
    ``at``, so a hot key is no single task."""
    cut = rows.withColumn("range", cut_ranges(rows, at, ranges))
    sizes = cut.groupBy(key, "range").agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "range", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(key, "range").orderBy(at, tie)
    return (cut.withColumn("n", F.row_number().over(inside)).join(offsets, [key, "range"])
               .withColumn("position", F.col("offset") + F.col("n") - 1).drop("n", "offset", "range"))
