"""Filter predicates B1-B13.  Each returns a ``Column``; none is a UDF.

Time tests take an explicit ``as_of`` (a ``datetime`` or ISO string): the cut
is computed on the driver once, so the test is a plain comparison with a
``TIMESTAMP_NTZ`` literal that Catalyst can push into a Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reclaim.functions.paths import _c, base_name, below, depth_below, glob_match

MIB = 1024 * 1024
DAY = _dt.timedelta(days=1)


def as_datetime(as_of) -> _dt.datetime:
    if isinstance(as_of, _dt.datetime):
        return as_of
    if isinstance(as_of, _dt.date):
        return _dt.datetime(as_of.year, as_of.month, as_of.day)
    return _dt.datetime.fromisoformat(str(as_of))


def ts_ntz(value) -> Column:
    """A ``TIMESTAMP_NTZ`` literal (``F.lit(datetime)`` would be session-zoned)."""
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def any_of(cols: Iterable[Column]) -> Column:
    cols = list(cols)
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def all_of(cols: Iterable[Column]) -> Column:
    cols = list(cols)
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def kind_in(*kinds: str, kind="kind") -> Column:
    """B1: ``f`` files, ``d`` directories, or both."""
    return _c(kind).isin(list(kinds))


def name_in(names: Iterable[str], path="path") -> Column:
    """B2: base name equals one of ``names`` (case-sensitive)."""
    return base_name(path).isin(list(names))


def name_glob_any(globs: Iterable[str], path="path") -> Column:
    """Base name matches any glob.  Suffix globs test the path end, which is
    the same as testing the base name when the suffix holds no ``/``."""
    tests = []
    for g in globs:
        if g.startswith("*") and "/" not in g and not any(ch in g[1:] for ch in "*?[\\"):
            tests.append(_c(path).endswith(g[1:]))
        else:
            tests.append(glob_match(g, base_name(path)))
    return any_of(tests)


def path_glob(glob: str, path="path") -> Column:
    """Whole path matches a glob in which ``*`` crosses ``/`` (``find -path``)."""
    return glob_match(glob, _c(path))


def not_under(prefix: str, path="path") -> Column:
    """The row is not strictly below a protected prefix."""
    return ~below(prefix, path)


def age_days_over(n: int, as_of, ts="mtime") -> Column:
    """B6 (``find -mtime +n``): whole days of age, fraction dropped, greater than n.
    So the row is at least n+1 days old.  Null times never match."""
    return _c(ts) <= ts_ntz(as_datetime(as_of) - (n + 1) * DAY)


def size_over(n: int, unit: int = MIB, size="size_bytes") -> Column:
    """B7 (``find -size +nM``): size rounded up to units is greater than n,
    which is the same as bytes greater than n * unit."""
    return _c(size) > F.lit(int(n) * int(unit))


def depth_is(root: str, k: int, path="path") -> Column:
    """``path`` is exactly ``k`` components below ``root``."""
    return below(root, path) & (depth_below(root, path) == F.lit(k))


def contains_any(needles: Iterable[str], col="line") -> Column:
    """The text holds any of several substrings."""
    return any_of(_c(col).contains(n) for n in needles)


def older_than(interval: _dt.timedelta, as_of, ts="ts") -> Column:
    """Exact age cut, strictly older than ``as_of - interval``."""
    return _c(ts) < ts_ntz(as_datetime(as_of) - interval)


def before_day_boundary(days: int, as_of, ts="ts") -> Column:
    """Before midnight of the day ``days`` ago (``DATE(NOW() - INTERVAL n DAY)``)."""
    cut = as_datetime(as_of) - days * DAY
    return _c(ts) < ts_ntz(_dt.datetime(cut.year, cut.month, cut.day))


def protect(names: Iterable[str], col) -> Column:
    """Never drop protected keys (null keys are not protected)."""
    return ~F.coalesce(_c(col).isin(list(names)), F.lit(False))


def line_matches(regex: str, col="line") -> Column:
    """The line matches a (Java) regular expression anywhere."""
    return _c(col).rlike(regex)
