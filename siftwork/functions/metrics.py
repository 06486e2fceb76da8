"""Scalar metric expressions (ANSI-safe: no division can raise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio(num, den) -> Column:
    """num / den as double, null when den is 0 or null."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def f_beta(precision, recall, beta: float) -> Column:
    """(1+b^2)PR / (b^2 P + R); 0 when the denominator is 0."""
    p, r = _c(precision), _c(recall)
    b2 = float(beta) ** 2
    return F.coalesce(F.try_divide((1 + b2) * p * r, b2 * p + r), F.lit(0.0))


def signif(col, digits: int) -> Column:
    """Round to `digits` significant figures; 0 stays 0, null stays null."""
    x = _c(col).cast("double")
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    scaled = F.pow(F.lit(10.0), k)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scaled) / scaled)
