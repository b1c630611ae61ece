"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.

language ID (documents it rejects go) -> exact dedup (of equal texts the
smallest doc_id stays) -> SimHash near-dedup (one document of each group stays)
-> mixing sources to target weights (documents are repeated or left out) ->
best-fit packing (a row for each piece).  All but the last return the columns
of their input.  Edge cases are those of the operators; an empty table passes
through every stage.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from reclaim.llm import block_naming, common, language_id, packing, pareto_mix, simhash_ring


#: Tables that a thread's last call of a stage has staged, by its place in STAGES.
_local = threading.local()


def _made() -> dict[int, list[str]]:
    if not hasattr(_local, "made"):
        _local.made = {}
    return _local.made


def _stage(place: int, function):
    """Before a stage starts, the tables that its predecessor staged go, unless
    its input still reads them (it has been written and read again)."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _made().pop(place - 1, []), keep_for=docs)
        before = set(common.staged())
        out = function(docs)
        _made()[place] = [p for p in common.staged() if p not in before]
        return out
    return run_stage


def _language(docs: DataFrame) -> DataFrame:
    return language_id.keep_identified(docs, language_id.learn(docs))


def _mix(docs: DataFrame) -> DataFrame:
    return pareto_mix.Mix(docs).apply(docs)


STAGES = [
    ("language_id", _stage(0, _language)),
    ("exact_dedup", _stage(1, block_naming.drop_copies)),
    ("simhash_near_dedup", _stage(2, simhash_ring.drop_near_copies)),
    ("pareto_mix", _stage(3, _mix)),
    ("best_fit_packing", _stage(4, packing.pack)),
]

#: Compression, XXH64 and the tokenizer can't be expressed in SQL; the tests
#: hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for name, function in STAGES:
        out = common.stage(function(spark, docs, sf_dir), f"pipeline-{name}", text=True)
        common.release(spark, last, keep_for=out)
        docs, last = out, common.staged()[-1:]
    # the result is written: what the last stage staged for it goes too
    common.release(spark, _made().pop(len(STAGES) - 1, []), keep_for=docs)
    return docs
