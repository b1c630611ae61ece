"""Rules as Spark Columns: registry (J1), all hits (C1), first match (E7), union of steps (G1).

A rule is a named boolean ``Column`` over the inventory.  Every selected rule
is evaluated in the same projection over one scan -- no rules x files join.
Rules run in sequence in the reference, so a row already removed by an
earlier rule is not there for a later one: the first match in run order owns
the row, which is ``coalesce(when(p1, r1), when(p2, r2), ...)``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Iterable, Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reclaim.functions.paths import at_or_below
from reclaim.functions.predicates import any_of
from reclaim.operators.rule_index import Where, candidates

#: Rules whose test is data go through the index where there are more of them than this.
INDEX_FROM = 64
#: Rules tested in one generator: the code of more of them is a method that the JVM does not compile.
RULES_AT_ONCE = 4
#: More roots than this reach the scan as their parents, which hold them all.
MAX_SCAN_ROOTS = 64


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: Optional[Column]
    requires_approval: bool = False
    required_tools: tuple = ()          # any one of them must exist on the host
    prepare: Optional[Callable[[DataFrame], DataFrame]] = None  # adds columns the predicate reads
    description: str = ""
    roots: tuple = ()                   # the rule can only match rows at or below these paths
    flags: tuple = ()                   # DirFlag specs: directory-row tests the predicate reads
    steps: tuple = ()                   # ListingStep: what the rule drops from other inputs
    where: Optional[Where] = None       # a test that is data, in place of a predicate

    @property
    def acts_on_files(self) -> bool:
        return self.predicate is not None or self.where is not None

    @property
    def test(self) -> Column:
        """The predicate within the rule's roots.  A rule without an inventory
        part has no predicate and matches no row."""
        if self.where is not None:
            return self.where.test
        if self.predicate is None:
            return F.lit(False)
        return self.predicate & any_of(at_or_below(r) for r in self.roots) if self.roots else self.predicate


@dataclass(frozen=True)
class ListingStep:
    """A step of a rule over inputs other than the file inventory.

    ``drop(inputs)`` gets the frames by name and returns the dropped rows as
    (host, item, size_bytes); ``input`` is the one they are rows of, ``needs``
    all it reads; ``tools``: any one must be on the host."""
    input: str
    drop: Callable[[dict], DataFrame]
    needs: tuple = ()
    tools: tuple = ()


class RuleBook:
    """Name -> Rule.  A second registration under a name replaces the first."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self._rules: dict[str, Rule] = {}
        for r in rules:
            self.add(r)

    def add(self, rule: Rule) -> "RuleBook":
        self._rules[rule.name] = rule
        return self

    def register(self, name: str, predicate: Column, requires_approval: bool = False,
                 required_tools: Sequence[str] = (), prepare=None, description: str = "",
                 roots: Sequence[str] = ()) -> "RuleBook":
        """Register a user rule (a Column, not a Python UDF).  ``roots``, if
        given, bounds the rule: it matches only rows at or below those paths."""
        return self.add(Rule(name, predicate, requires_approval, tuple(required_tools), prepare, description,
                             tuple(roots)))

    def register_where(self, name: str, root: str, suffix: str = "", kind: Optional[str] = None, size_over: Optional[int] = None,
                       not_after=None, requires_approval: bool = False, required_tools: Sequence[str] = ()) -> "RuleBook":
        """J1 for rules by the thousand: a user rule that is data (``Where``)."""
        where = Where(root, suffix, kind, size_over, not_after)
        return self.add(Rule(name, None, requires_approval, tuple(required_tools), roots=(root,), where=where))

    def __contains__(self, name: str) -> bool:
        return name in self._rules

    def __getitem__(self, name: str) -> Rule:
        return self._rules[name]

    def __len__(self) -> int:
        return len(self._rules)

    def names(self) -> list[str]:
        """names in byte order (Python orders str by code point, which is
        UTF-8 byte order, the order Spark compares strings in)."""
        return sorted(self._rules)

    def rules(self, names: Iterable[str]) -> list[Rule]:
        return [self._rules[n] for n in names]

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """The rule table ``(name, requires_approval, required_tools)``; its size is
        the number of registered rules."""
        schema = T.StructType([T.StructField("name", T.StringType(), False),
                               T.StructField("requires_approval", T.BooleanType(), False),
                               T.StructField("required_tools", T.ArrayType(T.StringType()), False)])
        rows = [(r.name, r.requires_approval, list(r.required_tools)) for r in self._rules.values()]
        return spark.createDataFrame(rows, schema)


def prepare_all(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Add the columns the rules' predicates read: every directory flag of every
    rule in one split of the inventory, then any custom ``prepare`` step."""
    from reclaim.operators.tree import mark_dirs
    rules = list(rules)
    flags, names = [], set(df.columns)  # a flag already on the frame is not added twice
    for r in rules:
        for fl in r.flags:
            if fl.flag not in names:
                names.add(fl.flag)
                flags.append(fl)
    df = mark_dirs(df, flags)
    seen = set()
    for r in rules:
        if r.prepare is not None and id(r.prepare) not in seen:
            seen.add(id(r.prepare))
            df = r.prepare(df)
    return df


def all_hits(rules: Sequence[Rule]) -> Column:
    """Array of the names of every rule that matches the row, in run order."""
    arr = F.array(*[F.when(r.test, F.lit(r.name)) for r in rules]) if rules \
        else F.array().cast("array<string>")
    return F.filter(arr, lambda x: x.isNotNull())


def _top(root: str) -> str:
    parts = root.rstrip("/").split("/")
    return "/".join(parts[:2]) if len(parts) > 1 else ""


def _outermost(roots: Iterable[str]) -> list[str]:
    """The roots that are not below another one, which holds their rows already."""
    given = set(roots)
    above = lambda x: (x[:i] for i, c in enumerate(x) if c == "/")
    return sorted(x for x in given if not any(a in given for a in above(x)))


def reachable(df: DataFrame, rules: Sequence[Rule], path: str = "path") -> DataFrame:
    """The rows that some rule can reach.  Where every rule declares its roots
    this is an OR of prefix tests, which goes down to the Parquet scan and
    skips the row groups outside them."""
    roots = _outermost({x.rstrip("/") for r in rules for x in r.roots})
    if not rules or any(not r.roots for r in rules if r.acts_on_files):
        return df
    while len(roots) > MAX_SCAN_ROOTS:  # a prefix each, as deep as few enough of them allow
        deepest = max(x.count("/") for x in roots)
        roots = sorted({x.rsplit("/", 1)[0] if x.count("/") == deepest else x for x in roots})
        if "" in roots:
            return df
    return df.filter(any_of(at_or_below(x, path) for x in _outermost(roots)))


def _dispatch(rules: Sequence[Rule], value, path: str = "path") -> Column:
    """``coalesce(when(p_i, v_i) ...)`` in run order.  Rows are first routed by
    their top-level directory, so a row is tested only against the rules that
    can reach it; a rule without roots is on every route.  The order within a
    route is the run order, and every rule tests its own roots, so routing
    never changes an answer."""
    tagged = [(r, value(i, r)) for i, r in enumerate(rules)]
    nowhere = value(0, rules[0])

    def branch(group):
        return F.coalesce(*[F.when(r.test, v) for r, v in group]) if group else F.when(F.lit(False), nowhere)

    on = lambda r, t: not r.roots or any(_top(x) in ("", t) for x in r.roots)
    free = [(r, v) for r, v in tagged if on(r, "")]
    tops = sorted({_top(x) for r in rules for x in r.roots} - {""})
    p, out = F.col(path), None
    for t in tops:
        cond = p.startswith(t + "/") | (p == F.lit(t))
        here = branch([(r, v) for r, v in tagged if on(r, t)])
        out = F.when(cond, here) if out is None else out.when(cond, here)
    return branch(free) if out is None else out.otherwise(branch(free))


def first_match_name(rules: Sequence[Rule], path: str = "path") -> Column:
    """The first rule in run order that matches (null when none)."""
    if not rules:
        return F.lit(None).cast("string")
    return _dispatch(rules, lambda i, r: F.lit(r.name), path)


def first_match_seq(rules: Sequence[Rule], start: int = 1, path: str = "path") -> Column:
    """Position (1-based) in run order of the first matching rule.  With a name
    listed twice only the first position can match (X10)."""
    if not rules:
        return F.lit(None).cast("int")
    return _dispatch(rules, lambda i, r: F.lit(i + start), path)


def first_match(df: DataFrame, rules: Sequence[Rule], out: str = "rule",
                seq: Optional[str] = None, only_hits: bool = True) -> DataFrame:
    """E7 applied: each row gets the first matching rule; rows no rule hits are
    removed unless ``only_hits`` is False."""
    if only_hits:
        df = reachable(df, rules)
    df = prepare_all(df, rules)
    if not rules:
        df = df.withColumn(out, F.lit(None).cast("string"))
        if seq:
            df = df.withColumn(seq, F.lit(None).cast("int"))
        return df.filter(F.lit(False)) if only_hits else df
    # name and position come out of one evaluation of the rules; the row goes
    # through a generator, so the "hits only" filter cannot be pushed below it
    # and re-evaluate every predicate (as it would through a plain projection)
    data = [(i + 1, r.name, r.where) for i, r in enumerate(rules) if r.where is not None]
    data = data if len(data) > INDEX_FROM else []
    by_test = [(i, r) for i, r in enumerate(rules) if not data or r.where is None]
    place = {id(r): i for i, r in by_test}
    hit = None
    for n in range(0, len(by_test), RULES_AT_ONCE):
        part = _dispatch([r for _, r in by_test[n:n + RULES_AT_ONCE]],
                         lambda _, r: F.struct(F.lit(place[id(r)] + 1).alias("s"), F.lit(r.name).alias("n")))
        if hit is not None:
            df = df.select("*", F.explode(F.array(hit)).alias("_sofar")).drop("_before").withColumnRenamed("_sofar", "_before")
            part = F.coalesce(F.col("_before"), part)
        hit = part
    if data:
        df = candidates(df, data, "_indexed")
        hit = F.least(hit, F.col("_indexed")) if by_test else F.col("_indexed")
    df = df.select("*", F.explode(F.array(hit)).alias("_hit")).drop("_indexed", "_before")
    if only_hits:
        df = df.filter(F.col("_hit").isNotNull())
    df = df.withColumn(out, F.col("_hit.n"))
    if seq:
        df = df.withColumn(seq, F.col("_hit.s"))
    return df.drop("_hit")


def union_steps(df: DataFrame, steps: Sequence[Column]) -> DataFrame:
    """G1: a rule of several steps on the same input drops each row once: the
    steps are OR-ed in one filter (one scan, no dedupe)."""
    return df.filter(any_of(steps))


def union_step_frames(frames: Sequence[DataFrame], key: Sequence[str] | str) -> DataFrame:
    """G1 for steps over different inputs: one row per key, that of the first step
    that has it; of rows of one step that share a key, the least."""
    key = [key] if isinstance(key, str) else list(key)
    names = frames[0].columns
    rows = reduce(lambda a, b: a.unionByName(b), [f.select(
        *key, F.struct(F.lit(i).alias("_step"), *names).alias("_row")) for i, f in enumerate(frames)])
    return rows.groupBy(*key).agg(F.min("_row").alias("_row")).select(*[F.col(f"_row.`{c}`") for c in names])
