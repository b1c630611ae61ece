"""Report scalars H1, H2, H5, H6 as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reclaim.functions.paths import _c

# Fixed values that must equal the reference's output: unit letters of the
# 1024-based ladder, in order from kibi to exbi, and the fixed labels.
UNIT_LETTERS = "KMGTPE"
LABEL_INSIGNIFICANT = "Insignificant"
STATUS_SKIPPED, STATUS_ERROR, STATUS_SUCCESS = "Skipped", "Error", "Success"
STATUS_NOT_INSTALLED = "Not installed"
MESSAGE_SUCCESS = "Cleanup completed successfully"
MESSAGE_NOT_INSTALLED = "Skipped (not installed)"
MESSAGE_ERROR_PREFIX = "Error during cleanup: "


def format_bytes(n="bytes") -> Column:
    """H1: ``< 1024`` -> ``"%d B"``; else one decimal and KiB..EiB.

    The unit is the largest power of 1024 not above ``n`` (no promotion after
    rounding: 1048575 -> ``1024.0 KiB``).  The value is the number as a double,
    divided by the unit (exact, a power of two) and rounded to tenths, exact
    ties to even (1280 -> ``1.2 KiB``), in whole numbers of 64 bits.
    """
    v = _c(n).cast("long")
    # as printed from a double; the largest ones stay below 2^63, which reads the same
    d = F.least(v.cast("double"), F.lit(float(2 ** 63 - 1024)))
    x = d.cast("long")
    exp = F.lit(len(UNIT_LETTERS))
    for e in range(len(UNIT_LETTERS) - 1, 0, -1):
        exp = F.when(d < F.lit(float(1024 ** (e + 1))), e).otherwise(exp)
    shift = exp * 10
    right = lambda c, by: F.call_function("shiftright", c, by)
    low = lambda c, bits: c - F.call_function("shiftleft", right(c, bits), bits)
    # five times the rest in halves of the unit: ten times it would not fit into 64 bits
    fives = low(x, shift) * 5
    tenths = right(x, shift) * 10 + right(fives, shift - 1)
    rest, half = low(fives, shift - 1), F.call_function("shiftleft", F.lit(1).cast("long"), shift - 2)
    up = (rest > half) | ((rest == half) & (tenths % 2 == 1))
    tenths = tenths + up.cast("long")
    text = F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" "),
                    F.substring(F.lit(UNIT_LETTERS), exp, F.lit(1)), F.lit("iB"))
    return F.when(v < 1024, F.concat(v.cast("string"), F.lit(" B"))).otherwise(text)


def format_duration(seconds="duration_s") -> tuple[Column, Column]:
    """H2: ``< 1 s`` -> (ms, ``ms``); ``< 60 s`` -> (s, ``s``); else (min, ``m``)."""
    s = _c(seconds).cast("double")
    value = F.when(s < 1, s * 1000).when(s < 60, s).otherwise(s / 60)
    unit = F.when(s < 1, F.lit("ms")).when(s < 60, F.lit("s")).otherwise(F.lit("m"))
    return value, unit


def status_label(skipped="skipped", error="error") -> Column:
    """H5: Skipped before Error before Success."""
    return (F.when(F.coalesce(_c(skipped), F.lit(False)), F.lit(STATUS_SKIPPED))
            .when(_c(error).isNotNull(), F.lit(STATUS_ERROR))
            .otherwise(F.lit(STATUS_SUCCESS)))


def result_message(skipped="skipped", error="error") -> Column:
    """The run result text of a step: skipped, failed with its error, or done."""
    return (F.when(F.coalesce(_c(skipped), F.lit(False)), F.lit(STATUS_SKIPPED))
            .when(_c(error).isNotNull(), F.concat(F.lit(MESSAGE_ERROR_PREFIX), _c(error)))
            .otherwise(F.lit(MESSAGE_SUCCESS)))


def size_label(n="bytes") -> Column:
    """H6: ``Insignificant`` for 0, else :func:`format_bytes`."""
    return F.when(_c(n) == 0, F.lit(LABEL_INSIGNIFICANT)).otherwise(format_bytes(n))
