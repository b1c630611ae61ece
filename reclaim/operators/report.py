"""Reports: D1 per-rule reclaim, D2 grand total, D3 run report, D4 run maxima,
E6 capped share.

Per-rule aggregates group on a low-cardinality key (the rule), so the map-side
partial aggregate leaves one row per rule per task: no hot reducer whatever
the skew in the inventory.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclaim.functions.format import result_message, status_label

TOTAL_LABEL = "Total"


def reclaim_by_rule(hits: DataFrame, rule: str = "rule", size: str = "size_bytes",
                    extra_keys: Sequence[str] = ()) -> DataFrame:
    """Files and bytes per rule (the sum of the selected rows' bytes)."""
    return (hits.groupBy(*extra_keys, rule)
            .agg(F.count(F.lit(1)).alias("files"),
                 F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")))


def with_grand_total(hits: DataFrame, rule: str = "rule", size: str = "size_bytes") -> DataFrame:
    """D1 plus a footer row ``Total`` (``ROLLUP`` + ``grouping``)."""
    return (hits.rollup(rule)
            .agg(F.count(F.lit(1)).alias("files"),
                 F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"),
                 F.grouping(rule).alias("_g"))
            .select(F.when(F.col("_g") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col(rule)).alias(rule),
                    "files", "bytes"))


def run_report(statuses: DataFrame, per_seq: DataFrame, timings: Optional[DataFrame] = None) -> DataFrame:
    """D3: one row per selected rule, in run order.

    statuses: ``(seq, name, skipped, error)``; per_seq: ``(seq, files, bytes)``
    of the rows each run step owns (first match).  Skipped and failed steps and
    steps that hit nothing report 0 bytes."""
    r = statuses.join(per_seq, ["seq"], "left")
    if timings is not None:
        r = r.join(timings.select("seq", "duration_s"), ["seq"], "left")
    else:
        r = r.withColumn("duration_s", F.lit(0.0))
    ran = ~F.col("skipped") & F.col("error").isNull()
    return r.select(
        "seq", "name", status_label("skipped", "error").alias("status"),
        result_message("skipped", "error").alias("message"), "error",
        F.when(ran, F.coalesce(F.col("files"), F.lit(0))).otherwise(F.lit(0)).cast("long").alias("files"),
        F.when(ran, F.coalesce(F.col("bytes"), F.lit(0))).otherwise(F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.col("duration_s"), F.lit(0.0)).alias("duration_s"))


def max_over_run(report: DataFrame, col: str, run: Optional[str] = None, out: Optional[str] = None) -> DataFrame:
    """Maximum of ``col`` over the run, on every row (the report has one row
    per rule, so a window is right here)."""
    w = Window.partitionBy(run) if run else Window.partitionBy()
    return report.withColumn(out or f"max_{col}", F.max(col).over(w))


def share_of(value: str, whole: Column) -> Column:
    """``value`` / ``whole``; 0 where that is 0 or null."""
    return F.coalesce(F.try_divide(F.col(value).cast("double"), whole.cast("double")), F.lit(0.0))


def capped_share(df: DataFrame, value: str, cap, keys: Sequence[str] = (), out: str = "share",
                 max_out: Optional[str] = None) -> DataFrame:
    """``value / min(max over the run, cap)``; 0 when the divisor is 0 or
    null; not clamped, so it may exceed 1 (as the reference does).

    The max per run is a grouped aggregate joined back on the run keys (not a
    window), so one run holding a third of all rows is not one task.
    ``max_out`` keeps the run maximum (D4) as a column."""
    cap_c = cap if isinstance(cap, Column) else F.lit(cap)
    if keys:
        mx = df.groupBy(*keys).agg(F.max(value).alias("_max"))
        j = df.join(mx, list(keys), "left")
    else:
        mx = df.agg(F.max(value).alias("_max")).withColumn("_k", F.lit(1))
        j = df.withColumn("_k", F.lit(1)).join(F.broadcast(mx), ["_k"], "left").drop("_k")
    j = j.withColumn(out, share_of(value, F.least(F.col("_max"), cap_c)))
    return j.withColumnRenamed("_max", max_out) if max_out else j.drop("_max")
