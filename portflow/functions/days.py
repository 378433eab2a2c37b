"""Day ranges on frames that may be stored by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH_COLUMN = "service_month_start"


def within_days(df: DataFrame, start: Column | None, end: Column | None, col: str = "service_date") -> DataFrame:
    """Rows of the days from ``start`` to ``end`` (None: open).

    If the frame has the month column, the range is written on it too: a table
    stored by month then reads only the months it needs.
    """
    out = df
    for bound, keep in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            out = out.where(keep(F.col(col), bound))
            if MONTH_COLUMN in df.columns:
                out = out.where(keep(F.col(MONTH_COLUMN), F.trunc(bound, "month")))
    return out
