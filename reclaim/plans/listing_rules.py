"""Catalogue rules over listings and logs rather than the file tree (SURVEY
§2.10).  Each takes DataFrames and returns the rows the rule drops, with their
host and a ``rule`` column.  ``listing_steps`` binds them to the named inputs
of a run (``INPUTS``).
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclaim.functions.predicates import (MIB, before_day_boundary, contains_any, line_matches,
                                         older_than, protect)
from reclaim.functions.version import version_key
from reclaim.operators.retention import (before_current, drop_all_but_latest, over_budget, superseded,
                                         unreferenced)
from reclaim.operators.rules import ListingStep
from reclaim.sources.listings import (STAMP_FORMAT, STAMP_PATTERN, csv_field, fields_reason, json_env_names, json_reason,
                                      regex_all, regex_reason, ws_field)

# Fixed values that must equal the reference's.
KERNEL_PATTERN = "linux-image"
APT_PACKAGES = ["nano", "vim-tiny"]
SNAP_DISABLED = "disabled"
SDK_NEEDLES = ["system-images", "emulator"]
CONDA_PROTECTED = ["base"]
JOURNAL_RETAIN = dt.timedelta(days=3)
JOURNAL_BUDGET = 100 * MIB
BINLOG_DAYS = 7
TIMESHIFT_KEEP = 3
ARTIFACT_RULES = ["buildah", "docker", "flatpak", "pnpm", "podman"]

#: Inputs of a run besides the file inventory, by name.
INPUTS = {
    "log": "host string, id bigint, ts timestamp_ntz, size_bytes bigint",
    "binlogs": "host string, id bigint, ts timestamp_ntz, size_bytes bigint",
    "packages": "host string, line string",            # lines of the package listing
    "running": "host string, current string",          # running kernel version of each host
    "installed": "host string, package string",
    "snaps": "host string, line string",
    "snapshots": "host string, line string",
    "envs": "host string, doc string",
    "sdk": "host string, line string",
    "gems": "host string, gem string, version string, id bigint",
    "lxc_images": "host string, line string",          # CSV, image name first
    "lxc_containers": "host string, line string",      # CSV, container name first, its image second
    "lxc_running": "host string, container string",
    **{f"{r}_{k}": f"host string, item string{s}" for r in ARTIFACT_RULES
       for k, s in (("items", ", size_bytes bigint"), ("refs", ""))},
}

#: Text inputs: the column that is parsed, and why a text does not parse (null: it does).
PARSED = {
    "packages": ("line", lambda: fields_reason("line", 2)),
    "snaps": ("line", lambda: fields_reason("line", 3)),
    "snapshots": ("line", lambda: regex_reason("line", STAMP_PATTERN)),
    "envs": ("doc", lambda: json_reason("doc")),
    "sdk": ("line", lambda: fields_reason("line", 1)),
    "lxc_images": ("line", lambda: fields_reason("line", 1, ",")),
    "lxc_containers": ("line", lambda: fields_reason("line", 2, ",")),
}


def unparsed(inputs: dict) -> list[DataFrame]:
    """What the rules pass over in the text inputs given: input, host, text, reason."""
    return [inputs[n].select(F.lit(n).alias("input"), "host", F.col(text).alias("text"), reason().alias("reason"))
            .filter("reason is not null") for n, (text, reason) in PARSED.items() if n in inputs]


def _tag(df: DataFrame, rule: str) -> DataFrame:
    return df.withColumn("rule", F.lit(rule))


def kernels(listing: DataFrame, running: DataFrame, line: str = "line") -> DataFrame:
    """Kernel packages (second field of the package listing) in version order
    before the running one of their host, which ``running`` (host, current)
    names; none on hosts it does not name or whose kernel is not listed."""
    pk = listing.filter(line_matches(KERNEL_PATTERN, line)).select("host", ws_field(line, 1).alias("package"))
    now = running.groupBy("host").agg(F.collect_set("current").alias("_current"))  # a few versions a host
    pk = pk.join(now, "host")
    is_now = F.exists("_current", lambda v: F.col("package").contains(v))
    return _tag(before_current(pk, "host", version_key("package"), is_now).drop("_current"), "kernels")


def apt_packages(installed: DataFrame, name: str = "package") -> DataFrame:
    """The non-critical packages that are installed."""
    return _tag(installed.filter(F.col(name).isin(APT_PACKAGES)), "apt")


def snap_revisions(listing: DataFrame, line: str = "line") -> DataFrame:
    """Disabled revisions: name and revision, first and third field."""
    return _tag(listing.filter(line_matches(SNAP_DISABLED, line))
                .select("host", ws_field(line, 0).alias("snap"), ws_field(line, 2).alias("revision")), "snap")


def timeshift_snapshots(listing: DataFrame, line: str = "line") -> DataFrame:
    """Snapshot stamps in the listing, all but the newest three per host; a stamp
    listed twice is kept or dropped as one."""
    st = listing.select("host", F.explode(regex_all(line, STAMP_PATTERN)).alias("stamp")).distinct()
    st = st.withColumn("stamp_ts", F.to_timestamp_ntz("stamp", F.lit(STAMP_FORMAT)))
    return _tag(drop_all_but_latest(st, "host", "stamp_ts", TIMESHIFT_KEEP, tiebreak="stamp").drop("stamp_ts"),
                "timeshift")


def conda_envs(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Every environment of the JSON listing but the protected one."""
    return _tag(docs.select("host", F.explode(json_env_names(doc)).alias("env"))
                .filter(protect(CONDA_PROTECTED, "env")), "conda")


def android_packages(listing: DataFrame, line: str = "line") -> DataFrame:
    """System images and emulators (first field of the SDK listing)."""
    return _tag(listing.filter(contains_any(SDK_NEEDLES, line)).select("host", ws_field(line, 0).alias("package")),
                "android")


def unused(items: DataFrame, refs: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Artifacts nothing on their host uses (with ``host`` among the keys)."""
    return _tag(unreferenced(items, refs, list(keys)), rule)


def lxc_images(image_csv: DataFrame, containers: DataFrame, line: str = "line") -> DataFrame:
    """Images (first CSV field) that no container (host, image) of the host uses."""
    imgs = image_csv.select("host", csv_field(line, 0).alias("image"))
    return unused(imgs, containers.select("host", "image"), ["host", "image"], "lxc_lxd")


def lxc_containers(container_csv: DataFrame, running: DataFrame, line: str = "line") -> DataFrame:
    """Containers (first CSV field) that are not running (host, container)."""
    all_ = container_csv.select("host", csv_field(line, 0).alias("container"))
    return unused(all_, running.select("host", "container"), ["host", "container"], "lxc_lxd")


def old_logs(entries: DataFrame, as_of, ts: str = "ts") -> DataFrame:
    """The log step of the ``logs`` rule: entries older than three days."""
    return _tag(entries.filter(older_than(JOURNAL_RETAIN, as_of, ts)), "logs")


def journal_excess(entries: DataFrame, ts: str = "ts", size: str = "size_bytes") -> DataFrame:
    """The ``journal`` rule: per host the oldest beyond 100 MiB of the newest."""
    return _tag(over_budget(entries, "host", ts, JOURNAL_BUDGET, weight=size).filter("drop").drop("drop"), "journal")


def journal(entries: DataFrame, as_of, ts: str = "ts", size: str = "size_bytes") -> DataFrame:
    """Both log rules in run order, ``journal`` then ``logs``: every entry comes
    once, with the first rule that drops it.  (Entries that ``logs`` removes are
    older than those a budget keeps, so the order changes no decision.)"""
    marked = over_budget(entries, "host", ts, JOURNAL_BUDGET, weight=size)
    rule = F.when(F.col("drop"), "journal").when(older_than(JOURNAL_RETAIN, as_of, ts), "logs")
    return marked.withColumn("rule", rule).filter("rule is not null").drop("drop")


def binlogs(logs: DataFrame, as_of, ts: str = "ts") -> DataFrame:
    """Binary logs before midnight of the day a week ago."""
    return _tag(logs.filter(before_day_boundary(BINLOG_DAYS, as_of, ts)), "mysql_mariadb")


def old_gems(gems: DataFrame, name: str = "gem", version: str = "version", key: str = "id") -> DataFrame:
    """Every installed version but the newest of each gem of a host."""
    return _tag(superseded(gems, ["host", name], version_key(version), tiebreak=key), "ruby")


# ------------------------------------------------------------- steps of a run
def _items(df: DataFrame, item: Column, size: bool = False) -> DataFrame:
    bytes_ = F.coalesce("size_bytes", F.lit(0)) if size else F.lit(0)
    return df.select("host", item.cast("string").alias("item"), bytes_.cast("bigint").alias("size_bytes"))


def listing_steps(as_of) -> dict[str, tuple[ListingStep, ...]]:
    """What each rule does over the inputs of a run, in the order of its steps."""
    col, step = F.col, ListingStep

    def containers(i: dict) -> DataFrame:
        return i["lxc_containers"].select("host", csv_field("line", 1).alias("image"))

    def artifacts(rule: str) -> tuple[ListingStep, ...]:
        items, refs = f"{rule}_items", f"{rule}_refs"
        return (step(items, lambda i: _items(unused(i[items], i[refs], ["host", "item"], rule), col("item"), True),
                     (items, refs), (rule,)),)

    return {
        "kernels": (step("packages", lambda i: _items(kernels(i["packages"], i["running"]), col("package")),
                         ("packages", "running")),),
        "apt": (step("installed", lambda i: _items(apt_packages(i["installed"]), col("package")),
                     ("installed",), ("apt-get",)),),
        "logs": (step("log", lambda i: _items(old_logs(i["log"], as_of), col("id"), True), ("log",)),),
        "journal": (step("log", lambda i: _items(journal_excess(i["log"]), col("id"), True), ("log",)),),
        "snap": (step("snaps", lambda i: _items(snap_revisions(i["snaps"]), F.concat_ws(" ", "snap", "revision")),
                      ("snaps",), ("snap",)),),
        "timeshift": (step("snapshots", lambda i: _items(timeshift_snapshots(i["snapshots"]), col("stamp")),
                           ("snapshots",), ("timeshift",)),),
        "ruby": (step("gems", lambda i: _items(old_gems(i["gems"]), F.concat_ws(" ", "gem", "version")),
                      ("gems",), ("gem",)),),
        "android": (step("sdk", lambda i: _items(android_packages(i["sdk"]), col("package")),
                         ("sdk",), ("sdkmanager",)),),
        "conda": (step("envs", lambda i: _items(conda_envs(i["envs"]), col("env")), ("envs",), ("conda",)),),
        "mysql_mariadb": (step("binlogs", lambda i: _items(binlogs(i["binlogs"], as_of), col("id"), True),
                               ("binlogs",), ("mysql", "mariadb")),),
        "lxc_lxd": (step("lxc_images", lambda i: _items(lxc_images(i["lxc_images"], containers(i)), col("image")),
                         ("lxc_images", "lxc_containers"), ("lxc",)),
                    step("lxc_containers", lambda i: _items(lxc_containers(i["lxc_containers"], i["lxc_running"]),
                                                            col("container")),
                         ("lxc_containers", "lxc_running"), ("lxc",))),
        **{r: artifacts(r) for r in ARTIFACT_RULES},
    }


#: Rules with no part over the file inventory, and whether they need approval.
LISTING_ONLY = {"android": True, "apt": False, "buildah": True, "conda": True, "docker": True, "flatpak": False,
                "journal": True, "kernels": False, "lxc_lxd": True, "mysql_mariadb": True, "pnpm": False,
                "podman": True, "ruby": False, "timeshift": True}
