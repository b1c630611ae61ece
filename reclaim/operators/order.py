"""Global order without one task: F1/F2 ranks over data of any size.

``Window.orderBy(...)`` with no partition moves every row to one task.  Here
the rows are range-partitioned and sorted on the order key, the lineage is cut
with a reliable checkpoint (in the session's shared checkpoint folder) so the
partition of every row is fixed even if an executor is lost and work is
recomputed, and the position is the partition's offset (one row per
partition, broadcast) plus the row's index inside its partition.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclaim.session import checkpoint_dir

_LOW_BITS = 33  # monotonically_increasing_id: partition index above, row index below


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "pos",
                      partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (make it total: end with a key)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    s = ranged.sortWithinPartitions(*order).checkpoint(eager=True)
    s = s.withColumn("_mid", F.monotonically_increasing_id())
    pid = F.shiftright("_mid", _LOW_BITS)
    counts = s.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # one row per partition: a proven bound, so the offsets are broadcast
    return (s.withColumn("_pid", pid)
            .join(F.broadcast(offsets), ["_pid"], "inner")
            .withColumn(out, F.col("_off") + F.col("_mid") % F.lit(2 ** _LOW_BITS) + 1)
            .drop("_mid", "_pid", "_off"))
