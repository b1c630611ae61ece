"""Plan and report sinks.

The plan leaves Spark as Parquet partitioned by rule, so a consumer (the actual
deleter, an audit job) reads only the rules it acts on.  Each write is a version
in a folder of its own, ``version=...``; a small manifest in ``_manifests`` names
it once all its files are there.  ``read_plan`` reads the newest version that has a
manifest, so a write that fails, or is under way, leaves the earlier plan as it
was.  Older versions are deleted after the switch.  Paths should be on
shared storage; :func:`scratch_path` puts ad-hoc output under the session's
checkpoint folder, never a machine-local temp folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from reclaim.session import checkpoint_dir

MANIFESTS = "_manifests"
MANIFEST_SCHEMA = "number bigint, version string, partition_by string, schema string"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def plan_versions(spark: SparkSession, path: str) -> list:
    """The manifests of the plan at ``path``, oldest first: as many as versions are kept."""
    fs, manifests = _file_system(spark, f"{path.rstrip('/')}/{MANIFESTS}")
    if not fs.exists(manifests):
        return []
    # a manifest under way is in a folder that starts with _ and is not read
    found = spark.read.schema(MANIFEST_SCHEMA).json(f"{path.rstrip('/')}/{MANIFESTS}/*")
    return sorted(found.filter("version is not null").collect(), key=lambda m: (m["number"], m["version"]))


def write_plan(plan: DataFrame, path: str, partition_by: str | None = "rule", keep: int = 2) -> str:
    """Write ``plan`` as the next version at ``path`` and keep the ``keep`` newest,
    so that a reader of the version before can finish."""
    spark, path = plan.sparkSession, path.rstrip("/")
    before = plan_versions(spark, path)
    number = before[-1]["number"] + 1 if before else 1
    version = f"version={number:08d}-{uuid.uuid4().hex[:8]}"  # two writers never share a folder
    w = plan.write.mode("error")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(f"{path}/{version}")
    # the switch: this one small file
    row = [(number, version, partition_by, plan.schema.json())]
    spark.createDataFrame(row, MANIFEST_SCHEMA).coalesce(1).write.json(f"{path}/{MANIFESTS}/{version}")
    for old in before[:max(0, len(before) + 1 - max(keep, 1))]:
        for gone in (f"{path}/{MANIFESTS}/{old['version']}", f"{path}/{old['version']}"):
            fs, p = _file_system(spark, gone)
            fs.delete(p, True)
    return path


def write_report(report: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """The report (one row per rule or step, plus totals) as one small file set;
    it is bounded by the rule table, so one partition is right."""
    report.coalesce(1).write.mode(mode).format(fmt).save(path)
    return path


def read_plan(spark: SparkSession, path: str, partition_by: str | None = "rule") -> DataFrame:
    """The newest whole version of the plan.  The partition column is read as a
    string, never inferred: a rule called ``007`` keeps its name."""
    versions = plan_versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no plan at {path}")
    last = versions[-1]
    folder = f"{path.rstrip('/')}/{last['version']}"
    written = T.StructType.fromJson(json.loads(last["schema"]))  # also where no row was written
    declared = T.StructType([T.StructField(f.name, T.StringType()) if f.name == partition_by else f for f in written])
    return spark.read.schema(declared).parquet(folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/reclaim-{name}-{uuid.uuid4().hex}"
