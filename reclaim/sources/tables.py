"""Table sources: the driver's parquet tables and the derived file inventory.

``inventory_from_events`` derives ``inv(host, path, kind, size_bytes, mtime,
atime, id)`` from ``events`` (the test data has no file table; the rule is
fixed in FIXTURES.md).  ``directories`` derives the directory rows: every
ancestor of a file, ``/home`` down to the parent, with the newest mtime below.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclaim.functions.paths import base_name, parent_dir, path_parts

INVENTORY_COLUMNS = ["host", "path", "kind", "size_bytes", "mtime", "atime", "id"]

# Fixed values of the derived inventory (FIXTURES.md §2): directory per event
# type, and the file suffix per event_id % 8, in order 0..7.
EVENT_DIRS = [("error", ".cache/app"), ("click", ".local/share/Trash/files"),
              ("signup", "logs")]
OTHER_EVENT_DIR = ".config/my-electron-app/Cache"
SUFFIXES = [".log", ".tmp", ".temp", ".swp", "~", ".pyc", ".vdi", ".txt"]
MARKER_NAME = "CMakeCache.txt"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, from a generator of one row each: filters above it use the
    computed columns and do not compute them again, once for each predicate."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def union_apart(frames: Sequence[DataFrame]) -> DataFrame:
    """The rows of all frames, each frame's in tasks of its own.  Spark runs the n-th
    partitions of frames that a join or an aggregate left partitioned alike one after the
    other in one task, which then holds the sorts of all of them; rows out of a
    generator are not known to be partitioned."""
    return reduce(DataFrame.unionByName, [computed_once(f) for f in frames])


def inventory_from_events(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "ts", "user_id", "event_type", "value")
    eid, et = F.col("event_id"), F.col("event_type")
    s = lambda c: c.cast("string")
    d = F.when(et == "view", F.concat(F.lit("proj"), s(eid % 7), F.lit("/build")))
    for k, v in EVENT_DIRS:
        d = d.when(et == k, F.lit(v))
    d = d.otherwise(F.lit(OTHER_EVENT_DIR))
    suffix = F.when(eid % 8 == 0, F.lit(SUFFIXES[0]))
    for i, sfx in enumerate(SUFFIXES[1:], start=1):
        suffix = suffix.when(eid % 8 == i, F.lit(sfx))
    name = (F.when((et == "view") & (eid % 5 == 0), F.lit(MARKER_NAME))
            .otherwise(F.concat(F.lit("f"), s(eid), suffix)))
    return computed_once(e.select(
        F.concat(F.lit("h"), s(F.col("user_id") % 4)).alias("host"),
        F.concat(F.lit("/home/u"), s(F.col("user_id")), F.lit("/"), d, F.lit("/"), name).alias("path"),
        F.lit("f").alias("kind"),
        F.floor(F.col("value") * 1048576).cast("long").alias("size_bytes"),
        F.col("ts").alias("mtime"),
        (F.col("ts") + F.make_dt_interval(days=(eid % 5).cast("int"))).alias("atime"),
        eid.alias("id"),
    ))


#: Declared, so that no partition value is inferred (a host ``007`` stays one).
INVENTORY_SCHEMA = ("host string, path string, kind string, size_bytes bigint, mtime timestamp_ntz, "
                    "atime timestamp_ntz, id bigint")
_STORED: dict = {}


def read_inventory(spark: SparkSession, path: str, names: bool = False) -> DataFrame:
    """A stored inventory (Parquet), with its declared columns; with ``names``, for
    one that ``write_inventory`` wrote, also ``dir`` and ``name``, the two parts of the path."""
    more = ["dir", "name"] if names else []
    schema = INVENTORY_SCHEMA + "".join(f", {c} string" for c in more)
    return spark.read.schema(schema).parquet(path).select(*INVENTORY_COLUMNS, *more)


def write_inventory(inventory: DataFrame, path: str) -> str:
    """Store an inventory the way a fleet's arrives: laid out by host, in ranges of
    (host, path), so that root filters skip row groups.  The directory and the
    name stand beside the path, the name with bloom filters: a test for a name
    reads the row groups that may hold it, where the end of a path would read all."""
    (inventory.select(*INVENTORY_COLUMNS, parent_dir("path").alias("dir"), base_name("path").alias("name"))
     .repartitionByRange("host", "path")  # AQE sizes the ranges from the data
     .write.mode("overwrite").option("parquet.bloom.filter.enabled#name", "true").partitionBy("host").parquet(path))
    return path


def store_inventory(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Store the derived inventory of ``sf_dir`` at ``path`` (``write_inventory``).
    From then on ``load_inventory`` reads it in this session; storing again
    replaces it."""
    write_inventory(inventory_from_events(read_table(spark, sf_dir, "events")), path)
    _STORED[spark.sparkContext.applicationId, sf_dir.rstrip("/")] = path
    return path


def load_inventory(spark: SparkSession, sf_dir: str, names: bool = False) -> DataFrame:
    """The inventory: as stored by ``store_inventory`` in this session, else
    derived from ``events`` on the fly; with ``names``, a stored one has ``dir`` and ``name``."""
    path = _STORED.get((spark.sparkContext.applicationId, sf_dir.rstrip("/")))
    if path:
        return read_inventory(spark, path, names)
    return inventory_from_events(read_table(spark, sf_dir, "events"))


def ancestors(path="path", first: int = 2) -> F.Column:
    """Array of the proper ancestor directories of ``path``, the one with
    ``first`` parts first (2 = ``/home`` for ``/home/u1/f``)."""
    parts = path_parts(path)
    n = F.size(parts)
    ks = F.slice(F.sequence(F.lit(first), F.greatest(n - 1, F.lit(first))), 1,
                 F.greatest(n - first, F.lit(0)))
    return F.transform(ks, lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def directories(inventory: DataFrame) -> DataFrame:
    """Directory rows ``(host, path, kind='d', mtime)``: distinct ancestors, newest
    mtime below.  The aggregate is partial (map-side), so a directory above a
    third of all files costs one row per map task, not a hot reducer."""
    return (inventory
            .select("host", "mtime", F.explode(ancestors("path")).alias("path"))
            .groupBy("host", "path")
            .agg(F.max("mtime").alias("mtime"))
            .select("host", "path", F.lit("d").alias("kind"), "mtime"))


def directory_rows(inventory: DataFrame, kind: str = "kind") -> DataFrame:
    """``(host, path, mtime)`` of every directory: the directory's own mtime where
    the inventory has its row (as ``find -mtime`` reads it), else the newest
    mtime below.  One pass: rows give their time to their ancestors, and a
    directory's row its own to itself."""
    above = F.transform(ancestors("path"), lambda p: F.struct(p.alias("path"), F.lit(False).alias("own")))
    itself = F.when(F.col(kind) == "d", F.array(F.struct(F.col("path"), F.lit(True).alias("own"))))
    given = F.explode(F.concat(above, F.coalesce(itself, F.array().cast("array<struct<path:string,own:boolean>>"))))
    rows = inventory.select("host", "mtime", given.alias("_d")).select("host", "mtime", "_d.*")
    own, below_ = F.max(F.when(F.col("own"), F.col("mtime"))), F.max(F.when(~F.col("own"), F.col("mtime")))
    return rows.groupBy("host", "path").agg(
        F.when(F.bool_or("own"), own).otherwise(below_).alias("mtime"))


def with_directories(inventory: DataFrame) -> DataFrame:
    """Files plus directory rows, same columns (derived dirs have null
    size/atime/id); directory rows already in the inventory are kept as they are."""
    dirs = directories(inventory).join(inventory.filter(F.col("kind") == "d").select("host", "path"),
                                       ["host", "path"], "left_anti").select(
        "host", "path", "kind", F.lit(None).cast("long").alias("size_bytes"), "mtime",
        F.lit(None).cast(inventory.schema["atime"].dataType).alias("atime"),
        F.lit(None).cast("long").alias("id"))
    return inventory.select(*INVENTORY_COLUMNS).unionByName(dirs)
