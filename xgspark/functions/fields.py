"""Nested-field access and label helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xgspark.config import GOAL_OUTCOME


def _field_types(df_or_schema) -> dict:
    schema = df_or_schema if isinstance(df_or_schema, T.StructType) else df_or_schema.schema
    return {f.name: f.dataType for f in schema.fields}


def name_field(df: DataFrame | T.StructType, candidates: Sequence[str]) -> Column:
    """Ordered candidate lookup of a display name.

    For each candidate column that exists, in order:
      * a record column (``struct<id, name>``) that is present returns its
        ``name`` -- even when that name is NULL, later candidates are not tried;
      (``df`` may also be a schema, to inspect it once for several lookups)
      * a flat column returns its value when it is not NULL / NaN.
    Absent candidates are skipped; with none usable the result is NULL.
    The schema is inspected once on the driver; the result is one ``CASE``.
    """
    types = _field_types(df)
    expr: Column = F.lit(None).cast("string")
    for name in reversed(list(candidates)):
        dtype = types.get(name)
        if dtype is None:
            continue
        c = F.col(name)
        if isinstance(dtype, T.StructType):
            has_name = any(f.name == "name" for f in dtype.fields)
            value = c["name"].cast("string") if has_name else F.lit(None).cast("string")
            expr = F.when(c.isNotNull(), value).otherwise(expr)
        elif isinstance(dtype, T.MapType):
            expr = F.when(c.isNotNull(), c["name"].cast("string")).otherwise(expr)
        else:
            present = c.isNotNull()
            if isinstance(dtype, (T.DoubleType, T.FloatType)):
                present = present & ~F.isnan(c)
            expr = F.when(present, c.cast("string")).otherwise(expr)
    return expr


def location_xy_variant(location: Column | str) -> tuple[Column, Column]:
    """A VARIANT location ``[x, y, ...]`` to numeric (x, y).

    Elements go through a lenient cast (numbers and numeric text are accepted,
    extra elements ignored); anything else -- NULL, a non-array, fewer than
    two elements, a non-numeric element -- gives NULL for that coordinate.
    """
    c = F.col(location) if isinstance(location, str) else location
    return (F.try_variant_get(c, "$[0]", "double"),
            F.try_variant_get(c, "$[1]", "double"))


def goal_label(outcome: Column) -> Column:
    """1 when the outcome name is the goal outcome, else 0 (NULL -> 0)."""
    return F.when(outcome == F.lit(GOAL_OUTCOME), F.lit(1)).otherwise(F.lit(0))


def named_of_variant(v: Column) -> Column:
    """A ragged name field (VARIANT: a record or a flat value) as ``{id, name}``.

    A present record keeps its name even when that is NULL (P1: no
    fall-through); a flat value is a record of that name; JSON null is absent.
    """
    record = F.schema_of_variant(v).startswith("OBJECT")
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.struct(
        F.when(record, F.try_variant_get(v, "$.id", "bigint")).alias("id"),
        F.when(record, F.try_variant_get(v, "$.name", "string"))
         .otherwise(F.try_variant_get(v, "$", "string")).alias("name")))
