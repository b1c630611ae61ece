"""Rules over a stream of inventory rows (Structured Streaming).

The reference has no streams.  Rule predicates are stateless row tests with a
fixed ``as_of``, so they apply to ``readStream`` unchanged: each micro-batch
row gets its first matching rule, the plan rows go to a Parquet sink
partitioned by rule, and the per-rule totals are a streaming aggregate whose
state is one row per rule.  Rules that need a join with directory rows
(``prepare``) are refused here -- their answer can change when a later batch
brings the marker file.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reclaim.operators.rules import Rule, first_match_name, first_match_seq


def plan_stream(stream: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Streaming plan rows: the input rows some rule hits, with ``rule`` and ``seq``."""
    bad = [r.name for r in rules if r.prepare is not None or r.flags]
    if bad:
        raise ValueError(f"rules needing directory rows cannot run on a stream: {bad}")
    return (stream.withColumn("rule", first_match_name(rules))
            .withColumn("seq", first_match_seq(rules))
            .filter(F.col("rule").isNotNull()))


def reclaim_totals_stream(plan: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Running files and bytes per rule (state: one row per rule)."""
    return plan.groupBy("rule").agg(F.count(F.lit(1)).alias("files"),
                                    F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def write_plan_stream(plan: DataFrame, path: str, checkpoint: str, trigger_once: bool = False) -> StreamingQuery:
    """Append plan rows to Parquet, partitioned by rule.  ``checkpoint`` must be
    on shared storage so a restarted driver resumes exactly once."""
    w = (plan.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint).partitionBy("rule"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
