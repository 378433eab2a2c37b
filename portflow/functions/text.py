"""Text cleaning expressions for the staging layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Greek capitals folded to their plain letters.
ACCENTED_CAPITALS = "ΆΈΉΊΌΎΏΪΫ"
PLAIN_CAPITALS = "ΑΕΗΙΟΥΩΙΥ"

# The warehouse TRIM strips Unicode white space; Spark's trim strips only
# spaces, so strip the Unicode White_Space class at both ends instead.
_EDGE_WS = r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$"


def unicode_trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_WS, "")


def clean_text(c: Column) -> Column:
    """trim → collapse inner white-space runs (ASCII class) to one space → '' to NULL."""
    return F.nullif(F.regexp_replace(unicode_trim(c), r"\s+", " "), F.lit(""))


def fold_port(c: Column) -> Column:
    """Port name: cleaned, upper-cased, accents folded, '' to NULL."""
    collapsed = F.regexp_replace(unicode_trim(c), r"\s+", " ")
    folded = F.translate(F.upper(collapsed), ACCENTED_CAPITALS, PLAIN_CAPITALS)
    return F.nullif(folded, F.lit(""))
