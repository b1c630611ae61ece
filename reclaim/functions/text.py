"""H7 text helpers: split by line / separator, trim of a character set, lower, contains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reclaim.functions.paths import _c


def lines(text) -> Column:
    """Array of the lines of a text block (``\\r\\n`` or ``\\n``)."""
    return F.split(_c(text), "\r?\n")


def field(col, sep: str, i: int) -> Column:
    """0-based ``i``-th field after a literal separator; null when missing."""
    import re as _re
    return F.get(F.split(_c(col), _re.escape(sep)), i)


def trim_chars(col, chars: str) -> Column:
    """Strip every character of ``chars`` from both ends."""
    return F.trim(_c(col), F.lit(chars))


def lower(col) -> Column:
    return F.lower(_c(col))


def is_yes(col) -> Column:
    """An answer counts as consent when it lower-cases to exactly ``y``."""
    return F.coalesce(F.lower(_c(col)) == F.lit("y"), F.lit(False))
