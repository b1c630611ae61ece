"""The registered queries of this package, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclaim.llm import (block_naming, collision_counting, language_id, line_windows, merkle, ordinal_quality, packing,
                         pareto_mix, resample, secret_scan, sharding, simhash_ring, toxicity)
from reclaim.llm.common import held_out
from reclaim.llm.oracle import SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
                         F.size("passages").alias("n_passages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = language_id.learn(docs)
    return language_id.identify(docs.select("doc_id", "text"), content).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from ``labels``: 0 low quality, 1 good but toxic, 2 good and not toxic."""
    docs = table(spark, sf_dir, "documents")
    graded = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    ratings = table(spark, sf_dir, "labels").select("doc_id", graded.alias("grade"))
    rated = ordinal_quality.grade(docs, ordinal_quality.fit(docs, ratings))
    return rated.select("doc_id", held_out("doc_id").alias("held_out"), "expected_grade", "tail", "selected")


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.Mix(table(spark, sf_dir, "documents")).decisions()


def op6_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_counting.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ring.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_windows.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("text_sha256"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: sizes near equal, equal texts together where a shard can hold them."""
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(merkle.manifest(table(spark, sf_dir, "documents")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_secret_scan, op3_language_id, op4_ordinal_quality, op5_pareto_mix,
    op6_block_naming, op7_packing, op8_collision_counting, op9_simhash, op10_line_windows, op11_sharding,
    op12_merkle_manifest, op13_importance_resampling, pipeline)}

ORACLE = dict(SQL)
