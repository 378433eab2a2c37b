"""Number formatting: literal inputs and the texts that the documented thresholds give."""

import pytest

from pyspark.sql import functions as F

from portflow.functions.fmt import compact, grouped_int, py_fixed, signed_pct

# value, two-decimal text, one-decimal text: the exact binary value is rounded, halves to the even digit
FIXED = [
    (0.0, "0.00", "0.0"), (-0.0, "-0.00", "-0.0"), (19.15, "19.15", "19.1"), (0.25, "0.25", "0.2"), (0.15, "0.15", "0.1"),
    (2.675, "2.67", "2.7"), (-2.5, "-2.50", "-2.5"), (-0.04, "-0.04", "-0.0"), (1.125, "1.12", "1.1"), (0.05, "0.05", "0.1"),
    (1.005, "1.00", "1.0"), (0.35, "0.35", "0.3"), (0.45, "0.45", "0.5"), (99.95, "99.95", "100.0"), (1234567.891, "1234567.89", "1234567.9"),
]

# value, short text: from a million on in millions with two decimals, from 100 000 on in whole thousands, from 10 000 on
# in thousands with one decimal, below that whole with separators; the sign takes no part in the choice
SHORT = [
    (0.0, "0"), (7.0, "7"), (0.5, "0"), (1.5, "2"), (2.5, "2"), (999.0, "999"), (1000.0, "1,000"), (1234.5, "1,234"), (9999.0, "9,999"),
    (9999.5, "10,000"), (10000.0, "10.0k"), (12250.0, "12.2k"), (12350.0, "12.3k"), (19150.0, "19.1k"), (54321.0, "54.3k"), (99999.0, "100.0k"),
    (100000.0, "100k"), (150500.0, "150k"), (151500.0, "152k"), (999999.0, "1000k"), (1000000.0, "1.00M"), (1125000.0, "1.12M"),
    (2345678.0, "2.35M"), (123456789.0, "123.46M"), (-5.0, "-5"), (-1234.0, "-1,234"), (-45678.0, "-45.7k"), (-250000.0, "-250k"), (-3000000.0, "-3.00M"),
]

PERCENT = [(0.0, "+0.0%"), (12.34, "+12.3%"), (-12.36, "-12.4%"), (-0.0, "-0.0%"), (0.05, "+0.1%"), (100.0, "+100.0%")]

WHOLE = [(0.0, "0"), (1234567.0, "1,234,567"), (-1000.4, "-1,000"), (0.5, "0"), (3.5, "4")]


@pytest.mark.parametrize(
    "table, column",
    [
        ([(v, b) for v, _, b in FIXED], lambda x: py_fixed(x, 1)),
        ([(v, a) for v, a, _ in FIXED], lambda x: py_fixed(x, 2)),
        (SHORT, compact),
        (PERCENT, signed_pct),
        (WHOLE, grouped_int),
    ],
    ids=["one decimal", "two decimals", "short", "percent", "whole"],
)
def test_texts(spark, table, column):
    df = spark.createDataFrame(table, "x double, text string")
    rows = df.select("x", "text", column(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in rows] == table
