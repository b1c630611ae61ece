"""C2 by interval labels: "below a directory" as a range of whole numbers.

The directories of an inventory, far fewer than its rows, are put in the order
of a walk: ``pre`` is a directory's place, ``last`` that of the last directory in its
subtree, so ``a`` lies at or below ``b`` where ``b.pre <= a.pre <= b.last``.  A test on
directories (any test: a name glob, a path, an attribute joined to them) is evaluated once
for each directory, not for every ancestor of every row, and one labelled tree
serves any number of tests.  Rows then meet their own directory by one equi-join.

Which directories lie in a passing interval is found in buckets of ``BUCKET`` places:
an interval has one entry in each bucket that it touches, and a running
maximum of the ends, in the order of a bucket, tells of every place whether
an interval is open there, however deep they nest.  No window holds more
than the places of a bucket and the intervals that start in it or run into it.

Building the tree runs a job (``global_row_number``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reclaim.functions.paths import _c, at_or_below, base_name, parent_dir, path_parts
from reclaim.operators.order import global_row_number
from reclaim.operators.tree import DirTest

BUCKET = 1 << 16


def _above(path: str):
    """The directory itself and its ancestors, the root ``/`` (written as an empty path) first."""
    parts = path_parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


@dataclass(frozen=True)
class DirTree:
    dirs: DataFrame  # host, dir, pre, last: a row for each directory with something below it, or of its own

    @staticmethod
    def of(inventory: DataFrame, path: str = "path", kind: str = "kind") -> "DirTree":
        own = F.when(_c(kind) == "d", _c(path)).otherwise(parent_dir(path))
        some = inventory.select("host", own.alias("dir")).distinct()
        every = some.select("host", F.explode(_above("dir")).alias("dir")).distinct()
        # a walk: what is below a directory comes right after it, as / comes before all that a name can hold
        order = [F.col("host"), F.replace(F.col("dir"), F.lit("/"), F.lit("\u0001"))]
        placed = global_row_number(every, order, out="pre")
        last = (placed.select(F.col("host").alias("_host"), "pre", F.explode(_above("dir")).alias("_dir"))
                .groupBy("_host", "_dir").agg(F.max("pre").alias("last")))
        same = F.col("host").eqNullSafe(F.col("_host")) & (F.col("dir") == F.col("_dir"))
        return DirTree(placed.join(last, same).select("host", "dir", "pre", "last"))

    def inside(self, passing: DataFrame) -> DataFrame:
        """``pre`` of the directories at or below one of ``passing`` (pre, last)."""
        bucket = F.explode(F.sequence(F.floor(F.col("pre") / BUCKET), F.floor(F.col("last") / BUCKET)))
        opens = passing.select("pre", "last", bucket.alias("bucket")).select(
            "bucket", F.greatest(F.col("pre"), F.col("bucket") * BUCKET).alias("at"), F.lit(0).alias("point"), "last")
        places = self.dirs.select(F.floor(F.col("pre") / BUCKET).alias("bucket"), F.col("pre").alias("at"), F.lit(1).alias("point"),
                                  F.lit(None).cast("long").alias("last"))
        upto = F.max("last").over(Window.partitionBy("bucket").orderBy("at", "point").rowsBetween(Window.unboundedPreceding, 0))
        return (opens.unionByName(places).withColumn("upto", upto).filter("point = 1 and upto >= at")
                .select(F.col("at").alias("pre")))

    def flagged(self, root: str, test: DirTest, skip_hidden: bool = False) -> DataFrame:
        """host, dir, passes (the directory passes the test), below (what lies in it
        is below a passing one): the directories for which one of them is true."""
        dirs = self.dirs.withColumn("passes", at_or_below(root, "dir") & test(F.col("dir"), base_name("dir")))
        passing = dirs.filter("passes")
        if skip_hidden:  # what a shell * names below a passing directory, with its subtree
            child = dirs.filter((F.col("dir") != "") & ~base_name("dir").startswith(".")).select("host", parent_dir("dir").alias("up"), "pre", "last")
            above = passing.select(F.col("host").alias("_host"), F.col("dir").alias("_dir"))
            same = F.col("host").eqNullSafe(F.col("_host")) & (F.col("up") == F.col("_dir"))
            open_ = child.join(above, same, "left_semi").select("pre", "last")
        else:
            open_ = passing.select("pre", "last")
        hit = dirs.join(self.inside(open_).withColumn("below", F.lit(True)), "pre", "left").withColumn("below", F.coalesce("below", F.lit(False)))
        return hit.filter("passes or below").select("host", "dir", "passes", "below")

    def under(self, rows: DataFrame, root: str, test: DirTest, contents_only: bool = True, skip_hidden: bool = False,
              path: str = "path", kind: str = "kind") -> DataFrame:
        """The rows of the inventory that ``under_dir`` with these arguments is true for."""
        hits = self.flagged(root, test, skip_hidden)
        hits = hits.select(F.col("host").alias("_host"), F.col("dir").alias("_dir"), "passes", "below")
        found = rows.withColumn("_up", parent_dir(path)).join(
            hits, F.col("host").eqNullSafe(F.col("_host")) & (F.col("_up") == F.col("_dir")), "left")
        named = ~base_name(path).startswith(".") if skip_hidden else F.lit(True)
        hit = F.coalesce(F.col("below") | (F.col("passes") & named), F.lit(False))
        out = found.withColumn("_hit", hit).drop("_host", "_dir", "_up", "passes", "below")
        if not contents_only:  # the directory's own row
            own = hits.filter("passes").select("_host", "_dir", F.lit(True).alias("_own"))
            out = out.join(own, F.col("host").eqNullSafe(F.col("_host")) & (_c(path) == F.col("_dir")) & (_c(kind) == "d"), "left")
            out = out.withColumn("_hit", F.col("_hit") | F.coalesce("_own", F.lit(False))).drop("_host", "_dir", "_own")
        return out.filter("_hit").drop("_hit")
