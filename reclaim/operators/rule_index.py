"""Many rules at once: an index by root and literal suffix picks the few rules
that a row can match (C1, E7, J1).

A rule whose test is data (``Where``: a root, the end of the name, kind, size, age) needs
no expression of its own.  Rules with the same root and suffix are one entry of the
index, found by the row's path cut to the depth of the root and its last
characters: one broadcast lookup for each (depth, suffix length) that
occurs, all in one stage, whatever the number of rules.  What is left of a
test is looked at for the candidates alone.

The index holds the registered rules, so its size is known when it is built: up
to ``BROADCAST_RULES`` it is broadcast, beyond that it is joined as any table.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclaim.functions.paths import _c, at_or_below, root_len

BROADCAST_RULES = 100_000
_ENTRY = "array<struct<seq:int,name:string,kind:string,size_over:bigint,not_after:timestamp_ntz>>"


@dataclass(frozen=True)
class Where:
    """At or below ``root``, the path ends with ``suffix`` (no ``/`` in it), of
    ``kind``, greater than ``size_over`` bytes, mtime not after ``not_after``."""
    root: str
    suffix: str = ""
    kind: Optional[str] = None
    size_over: Optional[int] = None
    not_after: Optional[dt.datetime] = None

    def __post_init__(self):
        if "/" in self.suffix:
            raise ValueError("a suffix is the end of a name")

    @property
    def test(self) -> Column:
        """The same as one expression."""
        t = at_or_below(self.root) & F.col("path").endswith(self.suffix)
        if self.kind is not None:
            t = t & (F.col("kind") == self.kind)
        if self.size_over is not None:
            t = t & (F.col("size_bytes") > self.size_over)
        if self.not_after is not None:
            t = t & (F.col("mtime") <= F.lit(self.not_after))
        return t


def candidates(df: DataFrame, wheres: Sequence[tuple[int, str, Where]], out: str, path: str = "path") -> DataFrame:
    """``df`` with ``out``: the first (seq, name) of ``wheres`` that matches, or null."""
    spark, entries = df.sparkSession, {}
    for seq, name, w in wheres:
        root = w.root.rstrip("/")
        lookup = entries.setdefault((root_len(w.root), len(w.suffix)), {})
        lookup.setdefault((root, w.suffix), []).append((seq, name, w.kind, w.size_over, w.not_after))
    columns = []
    for i, ((depth, length), lookup) in enumerate(sorted(entries.items())):
        index = spark.createDataFrame([(*k, v) for k, v in lookup.items()], f"_root string, _suffix string, _c{i} {_ENTRY}")
        if len(wheres) <= BROADCAST_RULES:
            index = F.broadcast(index)
        # the first ``depth`` parts of the path, and its last characters
        key = (F.substring_index(_c(path), "/", depth) == F.col("_root")) & (F.right(_c(path), F.lit(length)) == F.col("_suffix"))
        df = df.join(index, key, "left").drop("_root", "_suffix")
        columns.append(f"_c{i}")
    found = F.concat(*[F.coalesce(c, F.array().cast(_ENTRY)) for c in columns])
    fits = F.filter(found, lambda r: (r["kind"].isNull() | (r["kind"] == F.col("kind")))
                    & (r["size_over"].isNull() | (F.col("size_bytes") > r["size_over"]))
                    & (r["not_after"].isNull() | (F.col("mtime") <= r["not_after"])))
    first = F.array_min(F.transform(fits, lambda r: F.struct(r["seq"].alias("s"), r["name"].alias("n"))))
    return df.withColumn(out, first).drop(*columns)
