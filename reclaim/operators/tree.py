"""Tree operators A1, C2, C3 on an inventory ``(host, path, kind, ...)``.

A directory test is evaluated on the ancestors of each row *inside the row*
(``exists`` over the split path), so "everything below a directory called X"
is a projection, not a join.  Only tests that need the directory's own
attributes (its mtime, a marker file inside it) join with directory rows, and
then only the candidate rows that have a matching ancestor name are shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable, Iterable, Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclaim.functions.paths import (_c, at_or_below, base_name, below, glob_body, glob_literal, glob_match, parent_dir,
                                    path_parts, root_len, whole)
from reclaim.functions.predicates import any_of
from reclaim.sources.tables import union_apart


def scan_roots(df: DataFrame, roots: Iterable[str], path: str = "path") -> DataFrame:
    """A1: rows strictly below any of several roots."""
    return df.filter(any_of(below(r, path) for r in roots))


@dataclass(frozen=True)
class DirTest:
    """A test on a directory, given its path and its name.

    ``names`` (a name-only test) runs as an array overlap on the path parts;
    ``regex`` (a whole-path pattern, unanchored body) runs as one regex on the
    row's own path.  Both stay in generated code, with no per-ancestor string
    building; ``fn`` is the general form, evaluated per ancestor.

    ``holds``: texts one of which is in every path that passes, so that most rows are
    told by a plain search; of ``names`` they are known."""
    names: Optional[tuple] = None
    regex: Optional[str] = None
    fn: Optional[Callable[[Column, Column], Column]] = None
    holds: tuple = ()

    def may_hold(self, path="path", end: str = "") -> Column:
        """True for every path at or below a directory that passes (with ``end`` "/": below)."""
        texts = [f"/{x}{end}" for x in self.names] if self.names is not None else self.holds
        return any_of(_c(path).contains(x) for x in texts) if texts else F.lit(True)

    def __call__(self, dpath: Column, dname: Column) -> Column:
        if self.names is not None:
            return dname.isin(list(self.names))
        if self.regex is not None:
            return dpath.rlike(whole(self.regex))
        return self.fn(dpath, dname)


def named(*names: str) -> DirTest:
    return DirTest(names=tuple(names))


def dir_path_glob(*globs: str) -> DirTest:
    """``find -type d -path G`` (``*`` crosses ``/``), any of several globs."""
    holds = [glob_literal(g) for g in globs]
    return DirTest(regex="|".join(f"(?:{glob_body(g)})" for g in globs), holds=tuple(holds) if all(holds) else ())


def dir_name_glob(*globs: str) -> DirTest:
    return DirTest(fn=lambda d, n: any_of(glob_match(g, n) for g in globs))


def dir_path_regex(regex: str, holds: tuple = ()) -> DirTest:
    """Directory path matches ``regex`` (anchors at the ends are implied); ``holds`` as in ``DirTest``."""
    body = regex[1:] if regex.startswith("^") else regex
    body = body[:-1] if body.endswith("$") and not body.endswith("\\$") else body
    return DirTest(regex=body, holds=holds)


def _regex_exact_below(root: str, body: str) -> bool:
    """The one-regex form is exact when no proper ancestor of ``root`` can
    match the directory pattern (then every match is at or below the root)."""
    parts = root.rstrip("/").split("/")
    prefixes = ["/".join(parts[:i]) for i in range(1, len(parts))]
    rx = re.compile("(?s:" + body + ")")
    return not any(rx.fullmatch(p) for p in prefixes)


def under_dir(root: str, test: DirTest, contents_only: bool = True, skip_hidden: bool = False,
              path: str = "path", kind: str = "kind") -> Column:
    """C2 as a row predicate: the row lies in a directory at or below ``root``
    that passes ``test`` (``find root -type d <test>``).

    contents_only: ``{}/*`` -- the directory's contents, not itself.
    Otherwise ``{}`` -- the directory with its subtree (the row itself counts
    when it is a matching directory).
    skip_hidden: a shell ``*`` does not match first-level dot entries.
    """
    parts = path_parts(path)
    n = F.size(parts)
    r = root_len(root)
    scope = below(root, path) if contents_only else at_or_below(root, path)
    if test.names is not None and skip_hidden and contents_only:
        # the same, with a first entry below the directory that has no leading dot
        r0, words = re.escape(root.rstrip("/")), "|".join(re.escape(x) for x in test.names)
        above = [f"{r0}(?:/.*)?/(?:{words})"] + [r0] * (root.rstrip("/").rsplit("/", 1)[-1] in test.names)
        return scope & test.may_hold(path, "/") & _c(path).rlike(whole("(?:" + "|".join(above) + ")/[^./].*"))
    if test.names is not None and not skip_hidden:
        names = F.array(*[F.lit(x) for x in test.names])
        anc = F.slice(parts, r, F.greatest(n - r, F.lit(0)))  # parts r .. n-1
        hit = F.arrays_overlap(anc, names)
        if not contents_only:
            hit = hit | ((_c(kind) == "d") & base_name(path).isin(list(test.names)))
        return scope & test.may_hold(path) & F.coalesce(hit, F.lit(False))
    if test.regex is not None and _regex_exact_below(root, test.regex):
        body = "(?:" + test.regex + ")"
        below_rx = body + ("/[^./].*" if skip_hidden else "/.+")
        hit = _c(path).rlike(whole(below_rx))
        if not contents_only:
            hit = hit | ((_c(kind) == "d") & _c(path).rlike(whole(body)))
        return scope & test.may_hold(path) & hit
    top = n - 1 if contents_only else n

    def at(k):
        t = (k <= top) & test(F.array_join(F.slice(parts, 1, k), "/"), F.element_at(parts, k))
        if not contents_only:
            t = t & ((k < n) | (_c(kind) == "d"))
        if skip_hidden:
            nxt = F.element_at(parts, F.least(k + 1, n))
            t = t & ((k >= n) | ~nxt.startswith("."))
        return t

    ks = F.sequence(F.lit(r), F.greatest(top, F.lit(r)))
    return scope & F.exists(ks, at)


def contents_of(directory: str, skip_hidden: bool = True, path: str = "path") -> Column:
    """``rm -rf dir/*``: everything below ``dir``; with a shell ``*`` the
    first-level dot entries stay."""
    d = directory.rstrip("/")
    t = below(d, path)
    if skip_hidden:
        t = t & ~_c(path).startswith(d + "/.")
    return t


def subtree_of(directory: str, path: str = "path") -> Column:
    """``rm -rf dir``: the directory and everything below it."""
    return at_or_below(directory, path)


def matching_ancestors(root: str, test: DirTest, contents_only: bool = True,
                       skip_hidden: bool = False, path: str = "path", kind: str = "kind") -> Column:
    """Array of the directories (paths) at or below ``root`` passing ``test``
    that hold the row -- the explode form of :func:`under_dir`."""
    parts = path_parts(path)
    n = F.size(parts)
    r = root_len(root)
    top = n - 1 if contents_only else n
    ks = F.slice(F.sequence(F.lit(r), F.greatest(top, F.lit(r))), 1, F.greatest(top - r + 1, F.lit(0)))

    def keep(k):
        t = test(F.array_join(F.slice(parts, 1, k), "/"), F.element_at(parts, k))
        if not contents_only:
            t = t & ((k < n) | (_c(kind) == "d"))
        if skip_hidden:
            t = t & ((k >= n) | ~F.element_at(parts, F.least(k + 1, n)).startswith("."))
        return t

    scope = below(root, path) if contents_only else at_or_below(root, path)
    return F.when(scope & _may_match(root, test, contents_only, path),
                  F.transform(F.filter(ks, keep), lambda k: F.array_join(F.slice(parts, 1, k), "/"))) \
        .otherwise(F.array().cast("array<string>"))


def _may_match(root: str, test: DirTest, contents_only: bool, path: str) -> Column:
    """A cheap, generated-code test that is true for every row with a matching
    directory (it may be true for others): most rows of an inventory have none,
    and they skip the per-ancestor evaluation."""
    if test.names is not None:
        parts = path_parts(path)
        n = F.size(parts)
        r = root_len(root)
        names = F.array(*[F.lit(x) for x in test.names])
        # parts r .. n (the row's own name too, for directory rows in subtree mode)
        return test.may_hold(path) & F.coalesce(F.arrays_overlap(F.slice(parts, r, F.greatest(n - r + 1, F.lit(0))), names),
                                                F.lit(False))
    if test.regex is not None and _regex_exact_below(root, test.regex):
        return test.may_hold(path) & _c(path).rlike(whole("(?:" + test.regex + ")(?:/.*)?"))
    return F.lit(True)


def dir_contents(inventory: DataFrame, root: str, test: DirTest, contents_only: bool = True,
                 skip_hidden: bool = False, by_host: bool = True, size: str = "size_bytes") -> DataFrame:
    """C2 per directory: files and bytes held by each matching directory.

    A row is exploded only into the matching directories that hold it (nested
    matches count in each), then aggregated with a map-side partial aggregate,
    so a directory holding a third of all rows is not a hot reducer."""
    keys = ["host", "dir"] if by_host else ["dir"]
    return (inventory
            .select("host", size, F.explode(matching_ancestors(root, test, contents_only,
                                                               skip_hidden)).alias("dir"))
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("files"), F.sum(size).cast("long").alias("bytes")))


@dataclass(frozen=True)
class DirFlag:
    """A flag "the row is in a directory that passes a test on the directory's
    own row": ``dirs(inventory) -> DataFrame(host, dir)`` lists the passing
    directories; ``candidate`` is the row-local part of the test (its name or
    path), so only rows with a candidate ancestor take part in the join."""
    flag: str
    root: str
    candidate: DirTest
    dirs: Callable[[DataFrame], DataFrame]
    contents_only: bool = True


def mark_dirs(inventory: DataFrame, flags: Iterable[DirFlag], path: str = "path", kind: str = "kind") -> DataFrame:
    """C2/C3 when the directory test needs the directory's own row (its mtime,
    a marker inside it).  Adds one boolean column per flag.

    However many flags there are: rows without a candidate directory for any
    flag pass straight through; the others are exploded once into (flag,
    directory), met with one tagged set of passing directories by one equi-join
    (AQE broadcasts the set when small and splits a hot directory otherwise),
    put together by one ``bool_or`` per row key, and joined back.  A flag is a
    function of (host, path, kind), so that is the key: rows without an id, as
    derived directory rows, are found too."""
    flags = list(flags)
    if not flags:
        return inventory

    def candidates(i: int, f: DirFlag) -> Column:
        found = matching_ancestors(f.root, f.candidate, f.contents_only, path=path, kind=kind)
        return F.transform(found, lambda d: F.struct(F.lit(i).alias("flag"), d.alias("dir")))

    tagged = F.concat(*[candidates(i, f) for i, f in enumerate(flags)])
    some = any_of(_any_candidate(f, path) for f in flags)
    rest = inventory.filter(~some).select("*", *[F.lit(False).alias(f.flag) for f in flags])
    rows = inventory.filter(some)
    passing = union_apart([f.dirs(inventory).select("host", "dir", F.lit(i).alias("flag"))
                           for i, f in enumerate(flags)]).distinct()
    keys = ["host", path, kind]
    # a hash leads the keys of the joins: the start of a host or a path is that of most others,
    # and sorting by these compares whole texts
    each = (rows.select(*keys, F.explode(F.array_distinct(tagged)).alias("_d")).select(*keys, "_d.*")
            .withColumn("_h", F.xxhash64("host", "dir", "flag"))
            .join(passing.withColumn("_h", F.xxhash64("host", "dir", "flag")), ["_h", "host", "dir", "flag"], "left_semi"))
    hits = each.groupBy(*keys).agg(*[F.bool_or(F.col("flag") == i).alias(f.flag) for i, f in enumerate(flags)])
    hits = hits.select(F.xxhash64(*keys).alias("_kh"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *[f.flag for f in flags])
    same = [F.xxhash64(*[rows[k] for k in keys]) == hits["_kh"], *[rows[k].eqNullSafe(hits[f"_k{n}"]) for n, k in enumerate(keys)]]
    marked = rows.join(hits, same, "left").select(
        *[rows[c] for c in rows.columns], *[F.coalesce(f.flag, F.lit(False)).alias(f.flag) for f in flags])
    return rest.unionByName(marked)


def _any_candidate(f: DirFlag, path: str) -> Column:
    """True for every row with a candidate directory of the flag; never null."""
    scope = below(f.root, path) if f.contents_only else at_or_below(f.root, path)
    return F.coalesce(scope & _may_match(f.root, f.candidate, f.contents_only, path), F.lit(False))


def mark_under_dirs(inventory: DataFrame, root: str, candidate: DirTest, dirs: DataFrame,
                    flag: str, contents_only: bool = True, path: str = "path") -> DataFrame:
    """One flag of :func:`mark_dirs`, with the passing directories given."""
    return mark_dirs(inventory, [DirFlag(flag, root, candidate, lambda _: dirs, contents_only)], path)


def marked_dirs(inventory: DataFrame, dir_name: str, marker: str, path: str = "path", kind: str = "kind") -> DataFrame:
    """C3 helper: ``(host, dir)`` of directories called ``dir_name`` that directly
    hold a *file* called ``marker``."""
    # "/<dir_name>/<marker>" at the end: a suffix test, which Parquet can push down but no
    # row group can be skipped by; a stored name can be looked up in bloom filters
    p = parent_dir(path)
    if "name" in inventory.columns:
        inventory = inventory.filter(F.col("name") == marker)
    return (inventory
            .filter(_c(path).endswith(f"/{dir_name}/{marker}") & (_c(kind) == "f"))
            .select("host", p.alias("dir")).distinct())


def under_marked_dirs(inventory: DataFrame, root: str, dir_name: str, marker: str,
                      flag: str = "_marked", contents_only: bool = False) -> DataFrame:
    """Directories called ``dir_name`` that directly hold ``marker``, with
    their subtree (``contents_only``: without their own rows)."""
    mk = marked_dirs(inventory, dir_name, marker)
    return mark_under_dirs(inventory, root, named(dir_name), mk, flag, contents_only)
