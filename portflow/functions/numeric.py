"""Exact rounding and guarded division.

Averages and shares here are ratios of integer sums. Rounding them through
a double risks half-way cases landing on either side; the integer form
``(2*10^s*num + den) div (2*den)`` rounds the exact rational value half
away from zero for non-negative inputs and yields the same double in any
engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def int_div(a: Column, b: Column) -> Column:
    """Integral division for a ≥ 0, b > 0 (exact: ``a - a mod b`` is a multiple of b)."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def round_ratio(num, den, scale: int = 2, default: float | None = 0.0) -> Column:
    """round(num/den, scale), half away from zero, for num ≥ 0 and den > 0.

    ``default`` when den is 0 or NULL (None keeps NULL).
    """
    num, den = _col(num).cast("long"), _col(den).cast("long")
    p = 10**scale
    value = int_div(num * (2 * p) + den, den * 2).cast("double") / float(p)
    out = F.when(den > 0, value)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def safe_share(num, den) -> Column:
    """100*num/den as a double, 0 when den is 0 (no rounding)."""
    num, den = _col(num), _col(den)
    return F.when(den != 0, num.cast("double") / den.cast("double") * 100.0).otherwise(F.lit(0.0))
