"""The rule catalogue as data: every file-tree rule is a Column
over the inventory, built from the predicates and tree operators.

Rules or steps that act on listings or logs rather than the file tree (kernels,
snap revisions, conda environments, log stream cuts ...) are in
:mod:`reclaim.plans.listing_rules`; ``rulebook`` holds all 50 rules with both.

First-level dot entries of a directory whose contents go (a shell ``*``) stay,
in every rule.

``home`` stands for ``$HOME``/``~`` (the tool runs as root, so ``/root``).
Ages are the reference's day counts; queries on the 30-day test data pass
smaller ones.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclaim.functions.paths import below, whole
from reclaim.functions.predicates import (MIB, age_days_over, kind_in, name_glob_any,
                                         name_in, path_glob, size_over)
from reclaim.operators.rules import Rule, RuleBook
from reclaim.plans.listing_rules import LISTING_ONLY, listing_steps
from reclaim.operators.tree import (DirFlag, contents_of, dir_path_glob, dir_path_regex, marked_dirs,
                                    named, subtree_of, under_dir)

# Fixed values that must equal the reference's: names, globs, paths and day
# counts of the rules.
HOME_TEMP_GLOBS = ["*.tmp", "*.temp", "*.swp", "*~"]
AUTOTOOLS_NAMES = ["autom4te.cache", "config.status", "config.log", "configure~",
                   "Makefile.in", "aclocal.m4", ".deps", ".libs"]
BROWSER_CACHE_GLOBS = ["*/.cache/google-chrome/Default/Cache", "*/.cache/chromium/Default/Cache",
                       "*/.mozilla/firefox/*/Cache"]
LIBREOFFICE_GLOB = "*/.config/libreoffice/4/user/uno_packages/cache"
ELECTRON_GLOB = "*/.config/*electron*"
KDENLIVE_GLOB = "*/kdenlive/render/*"
BLENDER_GLOB = "*/blender_*_autosave.blend"
THUMBNAILS_DIR_REGEX = r"^/home/[^/.][^/]*/\.cache/thumbnails$"  # shell /home/*/.cache/thumbnails
LOG_DAYS, TEMP_ATIME_DAYS, OLD_DAYS = 30, 10, 90
USER_LOG_MIB = 10


def cmake_flag(flag: str = "_cmake_marked") -> DirFlag:
    """The row is in (or is) a ``build`` directory under /home that directly
    holds ``CMakeCache.txt`` (C3)."""
    return DirFlag(flag, "/home", named("build"), lambda inv: marked_dirs(inv, "build", "CMakeCache.txt"),
                   contents_only=False)


def wine_flag(home: str, as_of, days: int, flag: str = "_wine_old") -> DirFlag:
    """The row is in (or is) a directory ``$HOME/.wine*`` (depth 1) whose own
    mtime is more than ``days`` days old.  The directory's row comes from the
    inventory (its own mtime) or, when the inventory lists files only, is derived
    from the rows inside it (newest mtime below)."""
    from reclaim.sources.tables import directory_rows
    h = home.rstrip("/")
    body = re.escape(h) + r"/\.wine[^/]*"

    def dirs(inv: DataFrame) -> DataFrame:
        inside = inv.filter(below(h) & F.col("path").rlike(whole(body + "(?:/.*)?")))
        return (directory_rows(inside)
                .filter(F.col("path").rlike(whole(body)) & age_days_over(days, as_of, "mtime"))
                .select("host", F.col("path").alias("dir")))
    return DirFlag(flag, h, dir_path_regex(body, (f"{h}/.wine",)), dirs, contents_only=False)


# Fixed values that must equal the reference's: the roots of the rules.
def rule_roots(home: str = "/root") -> dict:
    """Where each rule can match: it is tested only at or below these."""
    h = home.rstrip("/")
    return {
        "logs": ("/var/log",), "crash": ("/var/crash", "/var/lib/systemd/coredump"), "temp": ("/tmp", "/var/tmp"),
        "home": ("/home",), "cache": ("/home",), "trash": ("/home", "/root/.local/share/Trash"),
        "user_logs": ("/home",), "virtualbox": (f"{h}/VirtualBox VMs",), "vagrant": (f"{h}/.vagrant.d/boxes",),
        "snap": ("/var/lib/snapd/cache",), "python": ("/home", "/tmp"), "libreoffice": ("/home",),
        "browser": ("/home",), "deno": (f"{h}/.cache/deno",), "bun": (f"{h}/.bun/install/cache",),
        "pipenv": (f"{h}/.cache/pipenv",), "gradle": (f"{h}/.gradle/caches",), "wine": (h,),
        "electron": ("/home",), "kdenlive": (h,), "blender": (h,),
        "steam": (f"{h}/.steam/steam/steamapps/downloading",), "thunderbird": (f"{h}/.thunderbird",),
        "dropbox": (f"{h}/.dropbox/cache",), "maven": (f"{h}/.m2/repository",),
        "rust": (f"{h}/.cargo/registry", f"{h}/.cargo/git"), "jetbrains": (f"{h}/.local/share/JetBrains",),
        "mercurial": ("/home", f"{h}/.hg/bundle-backup"), "cmake": ("/home",), "autotools": ("/home",),
        "kubectl": (f"{h}/.kube/cache", f"{h}/.kube/http-cache"),
        "helm": (f"{h}/.cache/helm", f"{h}/.local/share/helm"), "minikube": (f"{h}/.minikube/cache",),
        "terraform": (f"{h}/.terraform.d/plugin-cache",), "ansible": (f"{h}/.ansible/tmp",),
        "containerd": ("/var/lib/containerd/io.containerd.snapshotter.v1.overlayfs",),
    }


def file_rules(as_of, home: str = "/root", log_days: int = LOG_DAYS,
               temp_days: int = TEMP_ATIME_DAYS, old_days: int = OLD_DAYS) -> list[Rule]:
    roots = rule_roots(home)
    return [dataclasses.replace(r, roots=roots[r.name])
            for r in _file_rules(as_of, home, log_days, temp_days, old_days)]


# Fixed values that must equal the reference's: paths, names and tools in the rules.
def _file_rules(as_of, home, log_days, temp_days, old_days) -> list[Rule]:
    h = home.rstrip("/")
    f = kind_in("f")
    R = Rule
    return [
        R("logs", below("/var/log") & f & name_glob_any(["*.log"]) & age_days_over(log_days, as_of, "mtime"),
          requires_approval=True),
        R("crash", contents_of("/var/crash") | (below("/var/lib/systemd/coredump") & f),
          requires_approval=True),
        R("temp", (below("/tmp") | below("/var/tmp")) & f & age_days_over(temp_days, as_of, "atime")),
        R("home", (below("/home") & f & name_glob_any(HOME_TEMP_GLOBS))
          | under_dir("/home", dir_path_regex(THUMBNAILS_DIR_REGEX, ("/.cache/thumbnails",)), skip_hidden=True),
          requires_approval=True),
        R("cache", under_dir("/home", named(".cache"), skip_hidden=True), requires_approval=True),
        R("trash", under_dir("/home", named("Trash"), skip_hidden=True) | contents_of("/root/.local/share/Trash"),
          requires_approval=True),
        R("user_logs", below("/home") & f & name_glob_any(["*.log"]) & size_over(USER_LOG_MIB, MIB),
          requires_approval=True),
        R("virtualbox", below(f"{h}/VirtualBox VMs") & f & name_glob_any(["*.vdi"])
          & age_days_over(old_days, as_of, "mtime"), requires_approval=True, required_tools=("vboxmanage",)),
        R("vagrant", contents_of(f"{h}/.vagrant.d/boxes"), requires_approval=True, required_tools=("vagrant",)),
        R("snap", contents_of("/var/lib/snapd/cache"), required_tools=("snap",)),
        R("python", (below("/home") | below("/tmp"))
          & (under_dir("/home", named("__pycache__"), contents_only=False)
             | under_dir("/tmp", named("__pycache__"), contents_only=False)
             | name_glob_any(["*.pyc"]))),
        R("libreoffice", under_dir("/home", dir_path_glob(LIBREOFFICE_GLOB), skip_hidden=True)),
        R("browser", under_dir("/home", dir_path_glob(*BROWSER_CACHE_GLOBS), skip_hidden=True)),
        R("deno", contents_of(f"{h}/.cache/deno")),
        R("bun", contents_of(f"{h}/.bun/install/cache")),
        R("pipenv", contents_of(f"{h}/.cache/pipenv")),
        R("gradle", subtree_of(f"{h}/.gradle/caches")),
        R("wine", F.coalesce(F.col("_wine_old"), F.lit(False)), required_tools=("wine",),
          flags=(wine_flag(h, as_of, old_days),)),
        R("electron", under_dir("/home", dir_path_glob(ELECTRON_GLOB), skip_hidden=True)),
        R("kdenlive", below(h) & f & path_glob(KDENLIVE_GLOB), requires_approval=True,
          required_tools=("kdenlive",)),
        R("blender", below(h) & f & path_glob(BLENDER_GLOB), requires_approval=True,
          required_tools=("blender",)),
        R("steam", contents_of(f"{h}/.steam/steam/steamapps/downloading"), requires_approval=True,
          required_tools=("steam",)),
        R("thunderbird", under_dir(f"{h}/.thunderbird", named("Cache"), skip_hidden=True), requires_approval=True,
          required_tools=("thunderbird",)),
        R("dropbox", contents_of(f"{h}/.dropbox/cache"), requires_approval=True),
        R("maven", subtree_of(f"{h}/.m2/repository"), requires_approval=True, required_tools=("mvn",)),
        R("rust", subtree_of(f"{h}/.cargo/registry") | subtree_of(f"{h}/.cargo/git"),
          requires_approval=True, required_tools=("cargo",)),
        R("jetbrains", under_dir(f"{h}/.local/share/JetBrains", named(".caches"), contents_only=False),
          requires_approval=True),
        R("mercurial", (below("/home") & f & name_glob_any(["*.hg*.bak"]))
          | contents_of(f"{h}/.hg/bundle-backup"), requires_approval=True, required_tools=("hg",)),
        R("cmake", F.coalesce(F.col("_cmake_marked"), F.lit(False))
          | under_dir("/home", named("CMakeFiles"), contents_only=False),
          requires_approval=True, flags=(cmake_flag(),)),
        R("autotools", below("/home") & (kind_in("d", "f") & name_in(AUTOTOOLS_NAMES)
                                         | under_dir("/home", named(*AUTOTOOLS_NAMES))),
          requires_approval=True),
        R("kubectl", contents_of(f"{h}/.kube/cache") | contents_of(f"{h}/.kube/http-cache")),
        R("helm", contents_of(f"{h}/.cache/helm") | contents_of(f"{h}/.local/share/helm")),
        R("minikube", contents_of(f"{h}/.minikube/cache"), required_tools=("minikube",)),
        R("terraform", contents_of(f"{h}/.terraform.d/plugin-cache")),
        R("ansible", contents_of(f"{h}/.ansible/tmp")),
        R("containerd", contents_of("/var/lib/containerd/io.containerd.snapshotter.v1.overlayfs"),
          requires_approval=True, required_tools=("containerd",)),
    ]


def file_rulebook(as_of, home: str = "/root", **ages) -> RuleBook:
    return RuleBook(file_rules(as_of, home, **ages))


def rulebook(as_of, home: str = "/root", **ages) -> RuleBook:
    """All rules: those over the file inventory, with their steps over listings
    and logs, and those that have only such steps."""
    steps = listing_steps(as_of)
    book = RuleBook(dataclasses.replace(r, steps=steps.get(r.name, ())) for r in file_rules(as_of, home, **ages))
    for name, approval in LISTING_ONLY.items():
        book.add(Rule(name, None, requires_approval=approval, steps=steps[name]))
    return book
