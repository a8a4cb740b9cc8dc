"""Scoring expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from xgspark.config import INTERPRETATION_THRESHOLDS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def logistic_probability(intercept, coefficients: Sequence, features: Sequence) -> Column:
    """``1 / (1 + exp(-(b0 + sum(b_i * x_i))))`` as plain columns.

    ``intercept`` and ``coefficients`` are literals or columns (a per-row model
    joined in by key); ``features`` follow the trained feature order.
    """
    z = _col(intercept) if not isinstance(intercept, (int, float)) else F.lit(float(intercept))
    for b, x in zip(coefficients, features):
        bc = F.lit(float(b)) if isinstance(b, (int, float)) else _col(b)
        z = z + bc * _col(x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def interpret_xg(p, thresholds: Sequence[tuple[float, str]] = INTERPRETATION_THRESHOLDS) -> Column:
    """Descending threshold lookup, first ``p >= t`` wins, else the last label.

    NaN is tested first: in Spark ``NaN >= t`` is true, while the behaviour
    reproduced here treats it as failing every comparison (falls to the last
    label).  NULL also falls to the last label.
    """
    pc = _col(p)
    last = thresholds[-1][1]
    expr = F.when(pc.isNull(), F.lit(None).cast("string")).when(F.isnan(pc), F.lit(last))
    for t, label in thresholds:
        expr = expr.when(pc >= F.lit(float(t)), F.lit(label))
    return expr.otherwise(F.lit(last))


def round_half_even(c, digits: int = 4) -> Column:
    """The double nearest the decimal of ``digits`` places nearest the exact
    binary value, ties to the even digit (P6): 5.46805 (a little below that as a
    double) gives 5.468.  The formatter works on the exact value, where scaling
    first would round twice.  Below one unit of the last place the formatter
    decides by the printed digits, so there the half is compared.  From 2**52 on
    a double has no fraction; it, NaN and infinity stay as they are."""
    v = _col(c).cast("double")
    shown = F.call_function("format_number", v, F.lit("0." + "0" * digits))
    unit, half = Decimal(1).scaleb(-digits), float(Decimal(5).scaleb(-digits - 1))
    if Decimal(half) <= unit / 2:                  # a tie goes to zero, which is even
        half = math.nextafter(half, 1.0)
    small = F.signum(v) * F.when(F.abs(v) >= F.lit(half), F.lit(float(unit))).otherwise(F.lit(0.0))
    return (F.when(F.abs(v) < F.lit(float(unit)), small)
             .when(F.abs(v) < F.lit(float(1 << 52)), shown.cast("double")).otherwise(v))


def round_half_up(c, digits: int = 4) -> Column:
    """``floor(v * 10^d + 0.5) / 10^d``: how compared values are cut to digits,
    here and in the oracle (values below 10^12)."""
    scale = float(10 ** digits)
    return F.floor(_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
