"""Line dedup by overlapping windows of three lines.

Lines are what newlines separate.  Their white space is normalised (runs to one
space, none at the ends); blank lines take no part, but go when they lie inside
a removed passage.  Every three consecutive lines are a window, named by 128
bits of hash.  Of a window that occurs more than once the first occurrence (by
doc_id, then place) stays.  Every other occurrence is covered, unless it overlaps
the first one itself; the covered positions of a document are merged and its
lines there removed.

Windows are counted with a map-side sum, and only repeated ones meet their
occurrences again, in an equi-join whose hot keys AQE splits.  What gathers by
document is bounded by its own lines.

Edge cases: a null text counts as empty; texts of fewer than three lines that
are not blank never lose any; rows that repeat a doc_id count as documents of
their own (which comes first is fixed when the rows are staged); a null doc_id
comes last; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reclaim.llm.common import SPACE, stage, text_of

WINDOW = 3


def _windows(content: Column, n: int) -> Column:
    """Of an array of (pos, line): the first and last position and the hash of
    every n consecutive lines."""
    def window(i: Column) -> Column:
        lines = [content[i + k]["line"] for k in range(n)]
        return F.struct(content[i]["pos"].alias("a"), content[i + n - 1]["pos"].alias("z"),
                        F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit("second"), *lines).alias("h2"))
    some = F.size(content) >= n
    return F.when(some, F.transform(F.sequence(F.lit(0), F.greatest(F.size(content) - n, F.lit(0))), window))


def remove_spans(text: str, spans: list) -> tuple[str, str, int]:
    """The text without the lines in ``spans`` (pairs of first and last
    position, in order), the merged spans and the number of lines removed."""
    lines, merged = text.split("\n"), []
    for a, z in spans:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z])
    left, at = [], 0
    for a, z in merged:
        left += lines[at:a]
        at = z + 1
    return "\n".join(left + lines[at:]), ",".join(f"{a}-{z}" for a, z in merged), sum(z - a + 1 for a, z in merged)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text (what is left of it),
    n_lines, n_removed, removed (merged spans of line numbers from 0)."""
    lines = F.split(text_of(text_col), "\n")
    content = F.filter(F.transform(F.col("lines"), lambda x, i: F.struct(
        i.alias("pos"), F.trim(F.regexp_replace(x, SPACE, " ")).alias("line"))), lambda x: x["line"] != "")
    rows = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"), lines.alias("lines"))
            .withColumn("content", content)
            .select("doc_id", "text", F.size("lines").alias("n_lines"), _windows(F.col("content"), window).alias("windows")))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "lines", text=True)
    seen = rows.select("row", "doc_id", F.posexplode("windows").alias("nth", "w")).select("row", "doc_id", "nth", "w.*")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "nth")
    again = (seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
             .filter("n > 1").select("h1", "h2", F.col("first.row").alias("first_row"), F.col("first.nth").alias("first_nth")))
    later = (F.col("row") != F.col("first_row")) | (F.col("nth") >= F.col("first_nth") + window)
    spans = (seen.join(again, ["h1", "h2"]).filter(later).groupBy("row")
             .agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("spans")))

    @pandas_udf("text string, removed string, n_removed bigint")
    def removed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in parts:
            yield pd.DataFrame([(t, "", 0) if x is None else remove_spans(t, [(s["a"], s["z"]) for s in x])
                                for t, x in zip(texts, spans)], columns=["text", "removed", "n_removed"])

    # one join for rows with and without spans: texts are moved once
    out = rows.drop("windows").join(spans, "row", "left").withColumn("r", removed("text", "spans"))
    return out.select("doc_id", "r.text", "n_lines", "r.n_removed", "r.removed")
