"""Number formatting with Python's rules, in Spark arithmetic.

Python's ``f"{x:.kf}"`` rounds the exact binary value half-to-even; Java's
formatter (``format_string``) rounds the shortest decimal string half-up,
so 19.15 (stored as 19.1499999…) prints 19.1 in Python but 19.2 in Java.
``py_fixed`` reproduces Python: scale by 10^k, recover the exact rounding
error of that product with Dekker's error-free product, round half-even on
the exact value, and build the string from integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1 (Veltkamp split of a binary64)


def _let(x: Column, body: Callable[[Column], Column], once: bool) -> Column:
    """``body(x)``; with ``once``, ``x`` is evaluated once for all its uses.

    A number is used many times here, and pasting its whole expression each
    time makes nested formatting outgrow the size of a generated method.
    ``once`` binds it in a higher-order function, in which Spark allows no
    scalar subquery, so ``x`` must not hold one.
    """
    return F.element_at(F.transform(F.array(x), body), 1) if once else body(x)


def py_round_scaled(x: Column, k: int, once: bool = False) -> Column:
    """round-half-even(x * 10^k) on the exact binary value of x, as a long (k ≤ 11)."""
    s = float(10**k)

    def rounded(v: Column) -> Column:
        p = v * s
        c = v * _SPLIT
        hi = c - (c - v)
        lo = v - hi
        err = (hi * s - p) + lo * s  # exact v*s - p
        f = F.floor(p)
        frac = p - f
        up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (F.pmod(f, F.lit(2)) == 1))))
        return (f + F.when(up, 1).otherwise(0)).cast("long")

    return _let(x.cast("double"), rounded, once)


def _negative(x: Column) -> Column:
    """x < 0, or x is negative zero (Python keeps its sign: ``f"{-0.0:.1f}"`` is ``-0.0``)."""
    d = x.cast("double")
    return (d < 0) | (d.cast("string") == "-0.0")


def py_fixed(x: Column, k: int, once: bool = False) -> Column:
    """``f"{x:.{k}f}"``."""
    s = 10**k

    def digits(a: Column) -> Column:
        if k == 0:
            return a.cast("string")
        return F.concat(((a - F.pmod(a, F.lit(s))) / s).cast("long").cast("string"), F.lit("."),
                        F.lpad(F.pmod(a, F.lit(s)).cast("string"), k, "0"))

    def text(v: Column) -> Column:
        sign = F.when(_negative(v), F.lit("-")).otherwise(F.lit(""))
        return F.concat(sign, _let(F.abs(py_round_scaled(v, k, once)), digits, once))

    return _let(x.cast("double"), text, once)


def fixed(x: Column, decimals: int) -> Column:
    return py_fixed(x, decimals)


def grouped_int(x: Column, once: bool = False) -> Column:
    """``f"{x:,.0f}"``: rounded half-even, thousands separated by commas."""

    def text(v: Column) -> Column:
        sign = F.when(_negative(v), F.lit("-")).otherwise(F.lit(""))
        return F.concat(sign, F.format_number(F.abs(py_round_scaled(v, 0, once)), 0))

    return _let(x.cast("double"), text, once)


def compact(x: Column, once: bool = False) -> Column:
    """1.23M / 123k / 12.3k / 1,234 (PAN-N)."""

    def text(v: Column) -> Column:
        a = F.abs(v)
        return (
            F.when(a >= 1_000_000, F.concat(py_fixed(v / 1_000_000, 2, once), F.lit("M")))
            .when(a >= 100_000, F.concat(py_fixed(v / 1_000, 0, once), F.lit("k")))
            .when(a >= 10_000, F.concat(py_fixed(v / 1_000, 1, once), F.lit("k")))
            .otherwise(grouped_int(v, once))
        )

    return _let(x.cast("double"), text, once)


def signed_pct(x: Column, decimals: int = 1, once: bool = False) -> Column:
    """``f"{x:+.1f}%"``."""
    return _let(x.cast("double"), lambda v: F.concat(F.when(~_negative(v), F.lit("+")).otherwise(F.lit("")), py_fixed(v, decimals, once), F.lit("%")), once)
