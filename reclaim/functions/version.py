"""a version sort key, in the full order of ``sort -V``.

Text order of the key (UTF-8 bytes, as Spark compares) is version order:

* runs of digits compare as numbers of any length: leading zeros go, and the
  length, in ten digits, stands in front;
* in other runs ``~`` comes before the end of the text or a digit, these before
  letters, letters before all else; an end is as good as the number 0;
* file suffixes (``.tar.gz``) count only where what is before them is equal;
* the empty text, ``.``, ``..`` and names that start with a dot come first, in this order.

Versions that are equal in all this (``1.02`` and ``1.2``) are ordered by the
text itself, which closes the key.  Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reclaim.functions.paths import _c

# What stands for each class, in their order: below all letters, and above them.
_TILDE, _END, _NUMBER, _OTHER = "\u0001", "\u0002", "\u0003", "\u007f"
_SUFFIXES = r"(?s)(?:\.[A-Za-z~][A-Za-z0-9~]*)+\z"


def _runs_key(text: Column) -> Column:
    def sortable(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        number = F.concat(F.lit(_NUMBER), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        other = F.replace(F.regexp_replace(run, r"([^A-Za-z~])", _OTHER + "$1"), F.lit("~"), F.lit(_TILDE))
        return F.when(run.rlike(r"^[0-9]"), number).otherwise(other)

    text = F.when(text.rlike(r"[0-9]\z"), text).otherwise(F.concat(text, F.lit("0")))
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.concat(F.array_join(F.transform(runs, sortable), ""), F.lit(_END))


def version_key(col) -> Column:
    text = _c(col)
    first = (F.when(text == "", "0").when(text == ".", "1").when(text == "..", "2")
             .when(text.startswith("."), "3").otherwise("4"))
    return F.concat(first, _runs_key(F.regexp_replace(text, _SUFFIXES, "")), _runs_key(text), text)
