"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(d: Column) -> Column:
    """Monday of the week containing ``d``."""
    return F.trunc(d, "week")


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def season(d: Column) -> Column:
    m = F.month(d)
    return (
        F.when(m.isin(12, 1, 2), "winter")
        .when(m.isin(3, 4, 5), "spring")
        .when(m.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )

