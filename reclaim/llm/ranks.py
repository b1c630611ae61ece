"""Places in a global order, without one task that holds the order.

Rows are dealt by ranges of the order, sorted within each range and written;
a row's place is its place in its range plus the rows of its group in the
ranges before.  Only one row per group and range is summed up.  Rows equal in
the whole order are told apart by their place in the input, so even a third of
all rows with one value is dealt over many ranges.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclaim.llm.common import stage

#: ``monotonically_increasing_id`` keeps the partition above these bits.
_BITS = 33


def ranked(rows: DataFrame, group: str, order: Sequence[Column], label: str) -> DataFrame:
    """``rows`` with ``rank`` (bigint, from 0) within ``group``, a column that is
    never null, and ``n``, the rows of the group.  Rows that tie in ``order`` come
    in the order of the input.  ``rows`` should be cheap to read twice (a staged
    table): Spark samples them for the ranges.  Adds and drops ``_input``, ``_at``, ``_part``."""
    dealt = rows.withColumn("_input", F.monotonically_increasing_id())
    keys = [F.col(group).asc(), *order, F.col("_input").asc()]
    laid = stage(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_input")
                 .withColumn("_at", F.monotonically_increasing_id()), label)
    laid = laid.withColumn("_part", F.shiftright("_at", _BITS))
    runs = laid.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # a group has one run in each of its ranges, so this window holds at most as many rows as there are partitions
    own = Window.partitionBy(group)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                       F.sum("_n").over(own).alias("n"))
    return (laid.join(runs, [group, "_part"])
            .withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_at", "_part", "_first", "_before"))
