"""An inventory of system and root paths for the queries, derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclaim.sources.tables import computed_once, read_table

# Fixed values of the second derived inventory: paths ({id} is the row's id) and
# kinds, the row's by id modulo their number.  Every rule that the first
# inventory does not reach has rows here, beside near misses.
SYSTEM_PATHS = [
    ("/var/log/app/s{id}.log", "f"), ("/var/log/app/s{id}.txt", "f"), ("/var/crash/c{id}", "f"),
    ("/var/crash/.c{id}", "f"), ("/var/lib/systemd/coredump/core.{id}", "f"), ("/tmp/t{id}", "f"), ("/var/tmp/t{id}", "f"),
    ("/root/VirtualBox VMs/vm/d{id}.vdi", "f"), ("/root/.vagrant.d/boxes/b{id}", "f"), ("/root/.vagrant.d/boxes/.b{id}", "f"),
    ("/var/lib/snapd/cache/s{id}", "f"), ("/home/u/.config/libreoffice/4/user/uno_packages/cache/l{id}", "f"),
    ("/home/u/.cache/google-chrome/Default/Cache/g{id}", "f"), ("/home/u/.mozilla/firefox/p{id}/Cache/f", "f"),
    ("/home/u/.mozilla/firefox/p{id}/Cache/.f", "f"), ("/root/.cache/deno/d{id}", "f"), ("/root/.bun/install/cache/b{id}", "f"),
    ("/root/.cache/pipenv/p{id}", "f"), ("/root/.gradle/caches/.g{id}", "f"), ("/root/.wine{id}", "d"), ("/root/.wine-old/w{id}", "f"),
    ("/root/v/kdenlive/render/k{id}.mp4", "f"), ("/root/b/blender_{id}_autosave.blend", "f"),
    ("/root/.steam/steam/steamapps/downloading/s{id}", "f"), ("/root/.thunderbird/p{id}/Cache/t", "f"), ("/root/.thunderbird/p{id}/Cache/.t", "f"),
    ("/root/.dropbox/cache/d{id}", "f"), ("/root/.m2/repository/m{id}.jar", "f"), ("/root/.cargo/registry/r{id}", "f"), ("/root/.cargo/git/g{id}", "f"),
    ("/root/.local/share/JetBrains/i/.caches/j{id}", "f"), ("/home/u/r/x{id}.hg0.bak", "f"), ("/root/.hg/bundle-backup/h{id}", "f"),
    ("/home/u/c/CMakeFiles/m{id}", "f"), ("/home/u/c/p{id}/build", "d"), ("/home/u/c/p{id}/build/CMakeCache.txt", "f"),
    ("/home/u/c/q{id}/build/CMakeCache.txt", "d"), ("/home/u/a/d{id}/config.log", "f"), ("/home/u/a/d{id}/.deps/x.Po", "f"),
    ("/root/.kube/cache/k{id}", "f"), ("/root/.kube/http-cache/k{id}", "f"), ("/root/.cache/helm/h{id}", "f"), ("/root/.local/share/helm/h{id}", "f"),
    ("/root/.minikube/cache/m{id}", "f"), ("/root/.terraform.d/plugin-cache/t{id}", "f"), ("/root/.ansible/tmp/a{id}", "f"),
    ("/var/lib/containerd/io.containerd.snapshotter.v1.overlayfs/o{id}", "f"), ("/home/u/.cache/thumbnails/t{id}", "f"),
    ("/root/.local/share/Trash/t{id}", "f"), ("/home/u/.cache/.k{id}", "f"), ("/snap/core/s{id}.log", "f"),
]


def system_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second inventory, of system and root paths, derived from ``orders``: the
    row's path by its key, size by its customer, times by its date (a quarter is
    of the last day).  Rows that come in pairs in ``SYSTEM_PATHS`` share a
    number, so a directory's row and its marker meet."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    n, key = len(SYSTEM_PATHS), F.col("o_orderkey")
    at = (key % n).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in SYSTEM_PATHS]), at + 1)
    number = F.floor(key / n).cast("bigint")
    recent = F.col("o_custkey") % 4 == 0
    time = F.when(recent, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).otherwise(F.col("o_orderdate").cast("timestamp_ntz"))
    return computed_once(o.select(
        F.concat(F.lit("h"), (number % 4).cast("string")).alias("host"),
        F.replace(pick(0), F.lit("{id}"), number.cast("string")).alias("path"), pick(1).alias("kind"),
        (F.col("o_custkey") * 100).cast("bigint").alias("size_bytes"), time.alias("mtime"), time.alias("atime"),
        key.cast("bigint").alias("id")))
