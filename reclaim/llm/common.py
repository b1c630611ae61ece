"""Helpers shared by the operators: staged tables, splitting of hot groups,
connected components, and keeping chosen rows of a table."""

from __future__ import annotations

import sys
import threading
import types
import uuid
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Regular expression of a run of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Each thread has its own: pipelines in several threads do not meet.
_local = threading.local()


def _staged() -> list[str]:
    if not hasattr(_local, "staged"):
        _local.staged = []
    return _local.staged


# ------------------------------------------------------------- staged tables
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.
    Where a session names none, the warehouse serves in local mode; on a
    cluster it may be a folder of the driver alone, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stage(df: DataFrame, label: str, text: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.  This cuts the
    lineage: a lost executor costs its running tasks, and generated ids or a
    sort order stay as they were written.

    Tables with whole texts are compressed.  Others are written plain: Spark
    judges by the size of the files whether a side is small enough to broadcast,
    and a packed file would hide how much it holds.

    The table goes when it is released, and at the latest with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reclaim-{label}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} if text else {
        "compression": "none", "parquet.enable.dictionary": "false"})).parquet(path)
    _staged().append(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> list[str]:
    """The paths staged by this thread and not yet released."""
    return list(_staged())


def release(spark: SparkSession, paths: Sequence[str], keep_for: DataFrame) -> None:
    """Delete those staged tables in ``paths`` that ``keep_for`` does not read."""
    used = keep_for.inputFiles() if paths else []
    for path in paths:
        if not any(path.rsplit("/", 1)[1] in f for f in used):
            fs, p = _path(spark, path)
            fs.delete(p, True)
            if path in _staged():
                _staged().remove(path)


def worker_cache(key, make: Callable):
    """A value kept by the Python worker process from task to task."""
    store = sys.modules.setdefault("_reclaim_worker_cache", types.ModuleType("_reclaim_worker_cache"))
    if key not in store.__dict__:
        store.__dict__[key] = make()
    return store.__dict__[key]


# ------------------------------------------------------------------- columns
def text_of(name: str) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def held_out(id_col: str) -> Column:
    """True for rows that no model may learn from: crc32 of the id, as text,
    leaves 2 on division by 4.  A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def text_chunks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut only before white space."""
    a, n = 0, len(data)
    while n - a > size:
        b = a + size
        while b < n and data[b] not in b" \t\n\r\x0b\x0c":
            b += 1
        yield data[a:b]
        a = b
    yield data[a:]


# ------------------------------------------------- groups compared in blocks
def in_blocks(rows: DataFrame, keys: Sequence[str], member: str, block: int, label: str) -> DataFrame:
    """Lay out groups for comparing all members with each other.

    A group of up to ``block`` rows is one unit.  A larger one is dealt at
    random into blocks of about that size and becomes one unit for each pair
    of blocks, so no task ever holds more than two blocks of a group.  Adds
    the columns ``bi``, ``bj`` (the unit) and ``b`` (the row's block); the
    result is partitioned and sorted by unit.
    """
    hot = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
                .withColumn("_blocks", F.ceil(F.col("_n") / F.lit(float(block))).cast("int")).drop("_n"), label)
    blocks = F.coalesce("_blocks", F.lit(1))
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    laid = (rows.join(hot, list(keys), "left").withColumn("b", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("bi", F.least("b", "_other")).withColumn("bj", F.greatest("b", "_other"))
            .drop("_blocks", "_other"))
    unit = [*keys, "bi", "bj"]
    return laid.repartition(*unit).sortWithinPartitions(*unit)


def whole_units(batches: Iterator[pd.DataFrame], unit: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows sorted by ``unit``, cut so that no unit is torn; with
    each batch, the number of the unit every row belongs to."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = np.ones(len(pdf), bool)
        for c in unit:
            last &= pdf[c].to_numpy() == pdf[c].iloc[-1]
        if last.all() and rest and all(rest[-1][c].iloc[-1] == pdf[c].iloc[0] for c in unit):
            rest.append(pdf)
            continue
        cut = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        whole = pd.concat([*rest, pdf.iloc[:cut]], ignore_index=True) if rest or cut else None
        if whole is not None and len(whole):
            yield whole, _unit_numbers(whole, unit)
        rest = [pdf.iloc[cut:]]
    if rest:
        whole = pd.concat(rest, ignore_index=True)
        yield whole, _unit_numbers(whole, unit)


def _unit_numbers(pdf: pd.DataFrame, unit: Sequence[str]) -> np.ndarray:
    new = np.zeros(len(pdf), bool)
    for c in unit:
        v = pdf[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def pairs_within(unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of rows of the same unit, a distance at a
    time, so that never more than one pair a row is held."""
    i = np.arange(len(unit) - 1)
    d = 1
    while len(i):
        i = i[i + d < len(unit)]
        i = i[unit[i] == unit[i + d]]
        if len(i):
            yield i, i + d
        d += 1


class Forest:
    """Connected components of the nodes 0..n-1 while links are added."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.root[i] != self.root[j]
        if apart.any():
            self.links.append((i[apart], j[apart]))
            self.held += int(apart.sum())
            if self.held > 4 * len(self.root) + 1024:
                self.settle()

    def settle(self) -> np.ndarray:
        if self.links:
            i = np.concatenate([a for a, _ in self.links])
            j = np.concatenate([b for _, b in self.links])
            self.links, self.held = [], 0
            while True:
                low = np.minimum(self.root[i], self.root[j])
                np.minimum.at(self.root, self.root[i], low)
                np.minimum.at(self.root, self.root[j], low)
                while True:
                    up = self.root[self.root]
                    if (up == self.root).all():
                        break
                    self.root = up
                if (self.root[i] == self.root[j]).all():
                    break
        return self.root


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of the links (u, v), both bigint and not null.

    Alternating large-star and small-star rounds: every node hands its larger,
    then its smaller neighbours to the smallest node it knows, until nothing
    changes.  Each round is a group-wise minimum (combined before the shuffle)
    and an equi-join whose hot keys AQE splits; each is staged.  Returns (node,
    component), component being the smallest node reachable; nodes without
    links do not appear.
    """
    spark = edges.sparkSession

    def distinct_staged(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = stage(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .distinct(), label)
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return e, tuple(mark)

    e, mark = distinct_staged(edges)
    while mark[0]:
        both = e.union(e.select("v", "u")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("low"))
        large = (both.join(low, "x").filter(F.col("y") > F.col("x"))
                 .select(F.col("y").alias("u"), F.least("x", "low").alias("v")))
        e = stage(large.distinct(), label)
        low = e.groupBy("u").agg(F.min("v").alias("low"))
        small = e.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        e, new = distinct_staged(small.union(low.select("u", "low")))
        if new == mark:
            break
        mark = new
    roots = e.select("v").distinct()
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
            if mark[0] else spark.createDataFrame([], "node bigint, component bigint"))


# ------------------------------------------------------------ keeping of rows
def text_key(name: str) -> Column:
    return F.sha2(text_of(name), 256)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, key: Column) -> DataFrame:
    """The rows of ``docs`` whose id and ``key`` (a hash of the whole text) are
    those of a row of ``kept`` (``_id``, ``_t``); of rows that repeat both, the
    first by their other columns.  The wanted rows need no row number that
    would have to survive a second read of the input.  Both keys are texts that
    are never null, so the join's partitions serve the choice of the first."""
    def named(i: Column) -> Column:
        return F.coalesce(F.concat(F.lit("i"), i.cast("string")), F.lit("null")).alias("_i")

    names = docs.columns
    rows = docs.select(named(F.col(f"`{id_col}`")), key.alias("_t"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = rows.join(kept.select(named(F.col("_id")), "_t"), ["_t", "_i"], "left_semi")
    order = [F.col(f"_row.`{c}`") for c in names if c != id_col and ordered(docs, c)] or [F.lit(0)]
    nth = F.row_number().over(Window.partitionBy("_t", "_i").orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select("_row.*")


def ordered(df: DataFrame, name: str) -> bool:
    """Maps and variants have no order, so they do not break ties."""
    kind = df.schema[name].dataType.simpleString()
    return "map<" not in kind and "variant" not in kind
