"""A whole run on Spark: select rules (C5, C6) -> approvals (C8) -> tools per host
(C7) -> what each step drops, first match in run order (E7) -> plan tables and
a report per step (D1, D3) with a grand total (D2).  Nothing is deleted; the
plans say what would be.

Which steps run is decided on the driver, from the rule book and the arguments,
without a Spark job.  The data-sized work is one projection over the inventory,
the listing steps over their own inputs, and a per-step aggregate.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Callable, Iterable, Mapping, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclaim.functions.format import MESSAGE_NOT_INSTALLED, STATUS_NOT_INSTALLED, STATUS_SUCCESS, format_bytes, size_label
from reclaim.functions.predicates import not_under
from reclaim.operators.report import max_over_run, reclaim_by_rule, run_report, share_of
from reclaim.operators.rules import Rule, RuleBook, first_match
from reclaim.operators.selection import SelectionError, ToolBits, answers, applicable_rules, selected_names
from reclaim.plans.listing_rules import unparsed
from reclaim.sources.sinks import read_plan, write_plan, write_report
from reclaim.sources.tables import union_apart

PROTECTED = ("/snap",)  # fixed value: the prefix the reference never walks into


@dataclass
class RunResult:
    plan: DataFrame      # inventory rows with the step (seq) and rule that would drop them
    items: DataFrame     # rows of the other inputs: seq, rule, input, host, item, size_bytes
    report: DataFrame    # one row per selected step: status, files, bytes, label
    total: DataFrame     # one row: files and bytes over the run, as text too
    quarantine: Optional[DataFrame] = None  # texts of the inputs that do not parse: input, host, text, reason
    reported: Optional[Callable[..., DataFrame]] = None  # the report of a plan and items (and measured times)
    steps: tuple = ()    # (seq, rows) of each listing step, before an item is given to its first step
    file_steps: tuple = ()  # seq of the steps over the inventory, which are evaluated together
    rules: Mapping[int, str] = field(default_factory=dict)  # the rule of each step
    places: tuple = ()  # of each of ``steps``, its place among the steps over its input

    def over(self, plan: Optional[DataFrame] = None, items: Optional[DataFrame] = None) -> "RunResult":
        """The same run with its plan or items read from where they were stored:
        the report then reads these, and the rules are not evaluated again."""
        plan, items = plan if plan is not None else self.plan, items if items is not None else self.items
        report = self.reported(plan, items)
        return replace(self, plan=plan, items=items, report=report, total=total_of(report))

    def store(self, path: str, measure: bool = False) -> "RunResult":
        """Write the whole run below ``path``: ``plan`` and ``items`` in versions
        (``write_plan``), ``quarantine`` where an input was a text, and ``report``, from
        the stored plan.  The inventory is read by the plan alone.

        With ``measure``, each listing step is written by itself first (``steps``) and
        the report has the seconds that took; the steps over the inventory are one
        evaluation, and each has its seconds."""
        spark, path = self.plan.sparkSession, path.rstrip("/")
        items, seconds = self.items, {}
        if measure:
            parts = []
            for n, (seq, rows) in enumerate(self.steps):
                started = time.perf_counter()
                parts.append(read_plan(spark, write_plan(rows, f"{path}/steps/{n}", None), None))
                seconds[seq] = seconds.get(seq, 0.0) + time.perf_counter() - started
            items = _first_step(parts, self.places, self.rules) if parts else items
        started = time.perf_counter()
        plan = read_plan(spark, write_plan(self.plan, f"{path}/plan"))
        for seq in self.file_steps if measure else ():
            seconds[seq] = seconds.get(seq, 0.0) + time.perf_counter() - started
        items = read_plan(spark, write_plan(items, f"{path}/items"))
        stored = self.over(plan, items)
        if measure:
            times = spark.createDataFrame(sorted(seconds.items()), "seq bigint, duration_s double")
            report = self.reported(plan, items, times)
            stored = replace(stored, report=report, total=total_of(report))
        if self.quarantine is not None:
            stored.quarantine = read_plan(spark, write_plan(self.quarantine, f"{path}/quarantine", "input"), "input")
        write_report(stored.report, f"{path}/report")
        return stored


def _first_step(listed: list[DataFrame], places: Iterable[int], rules: Mapping[int, str]) -> DataFrame:
    """Each item once, with the first step that drops it and, of rows of that step, the
    least size (null the least).  ``places``: of each frame, the place of its step among
    the steps over its input; ``rules``: the rule of each step.

    The sizes of each place are a column, so that all is found by hashing: the least
    of a struct takes a sort of all rows, by texts that are alike."""
    places = list(places)
    most = range(max(places, default=0) + 1)
    rows = union_apart([f.select("item", "host", "input", "seq", F.lit(at).alias("_at"), "size_bytes") for f, at in zip(listed, places)])
    here = lambda j, c: F.when(F.col("_at") == j, c)
    size = F.col("size_bytes")
    least = rows.groupBy("item", "host", "input").agg(
        F.min("seq").cast("bigint").alias("seq"), *[F.min(here(j, size)).alias(f"_size{j}") for j in most],
        *[F.max(here(j, size.isNull())).alias(f"_none{j}") for j in most])
    first = F.coalesce(*[F.when(F.col(f"_none{j}").isNotNull(), F.struct(F.when(~F.col(f"_none{j}"), F.col(f"_size{j}")).alias("size")))
                         for j in most])["size"]
    names = F.create_map(*[F.lit(x).cast(t) for seq, name in rules.items() for x, t in ((seq, "bigint"), (name, "string"))])
    return least.select("seq", names[F.col("seq")].alias("rule"), "input", "host", "item", first.alias("size_bytes"))


def total_of(report: DataFrame) -> DataFrame:
    return report.agg(F.sum("files").cast("long").alias("files"), F.sum("bytes").cast("long").alias("bytes")) \
        .withColumn("freed", format_bytes("bytes"))


def _pairs(what: str, given) -> dict:
    """A mapping, or pairs with no name twice."""
    if isinstance(given, Mapping):
        return dict(given)
    out: dict = {}
    for k, v in given or []:
        if k in out:
            raise SelectionError(f"more than one {what} for {k}")
        out[k] = v
    return out


def _tool_sets(rule: Rule) -> list[tuple]:
    """The tools of each part of a rule; a part without any applies everywhere."""
    own = [tuple(rule.required_tools)] if rule.acts_on_files or not rule.steps else []
    return own + [tuple(s.tools or rule.required_tools) for s in rule.steps]


def _listed(rules: list[tuple[int, Rule]], inputs: Mapping[str, DataFrame],
            host_tools: Optional[DataFrame]) -> tuple[list[tuple[int, DataFrame]], list[tuple[str, int]]]:
    """The number of each listing step of the active rules, and what it drops; and
    the input of each step, and its number."""
    out, inputs_of = [], []
    for seq, rule in rules:
        for step in rule.steps:
            if any(n not in inputs for n in step.needs):
                continue
            hits = step.drop(dict(inputs))
            tools = step.tools or rule.required_tools
            if host_tools is not None and tools:
                hosts = host_tools.filter(F.col("tool").isin(list(tools))).select("host")
                hits = hits.join(hosts, "host", "left_semi")
            inputs_of.append((step.input, seq))
            out.append((seq, hits.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(rule.name).alias("rule"),
                                         F.lit(step.input).alias("input"), "host", "item", "size_bytes")))
    return out, inputs_of


def run(spark: SparkSession, inventory: DataFrame, book: RuleBook, include: str = "", exclude: str = "",
        all_rules: bool = False, approvals: Optional[Iterable[tuple]] = None,
        host_tools: Optional[DataFrame] = None, errors=None, start_free_bytes: Optional[int] = None,
        timings: Optional[DataFrame] = None, protected: Iterable[str] = PROTECTED,
        inputs: Optional[Mapping[str, DataFrame]] = None) -> RunResult:
    """``approvals``: pairs (name, answer), see ``selection.answers``, or (position
    of the step from 1, answer).  ``errors``: (name, text) of rules that failed.
    ``inputs``: frames by name (``listing_rules.INPUTS``); a step whose inputs
    are not all there drops nothing, and the report names them.
    ``start_free_bytes`` (free space before the run) caps the bytes share at half
    of it; shares may exceed 1.  ``timings`` (``seq, duration_s``) fills the
    durations.  With ``host_tools`` (``host, tool``) a rule acts on the hosts that
    have one of its tools; the report counts the hosts it applies to and the
    others, and a step that applies to none has the status ``Not installed``.
    Rows below a ``protected`` prefix are removed before any rule
    (a ``NOT StartsWith`` filter, which reaches the Parquet scan)."""
    inputs = inputs or {}
    names = selected_names(book.names(), include, exclude, all_rules)
    failed = _pairs("error", errors)
    steps, active, seen = [], [], set()
    for seq, (name, answer) in enumerate(zip(names, answers(names, approvals or [])), 1):
        rule = book[name]
        skipped = rule.requires_approval and (answer or "").lower() != "y"
        lacking = sorted({n for s in rule.steps for n in s.needs if n not in inputs})
        steps.append((seq, name, skipped, failed.get(name), lacking))
        if not skipped and name not in failed and name not in seen:  # a second run of a rule finds nothing
            active.append((seq, rule))
            seen.add(name)
    st = spark.createDataFrame(steps, "seq bigint, name string, skipped boolean, error string, missing_inputs array<string>")

    inv = inventory
    for prefix in protected:
        inv = inv.filter(not_under(prefix))
    tests = [(seq, r) for seq, r in active if r.acts_on_files]
    hosts = None  # for each step, the hosts it applies to and the others
    if host_tools is not None:
        chosen = [book[name] for name in names]
        bits = ToolBits(t for r in chosen for tools in _tool_sets(r) for t in tools)
        by_host = bits.hosts(host_tools)
        counts = applicable_rules([_tool_sets(r) for r in chosen], by_host, bits)
        hosts = [(seq, name, *n) for (seq, name, *_), n in zip(steps, counts)]
        here = {name: n for _, name, n, _ in hosts}
        tests = [(seq, r) for seq, r in tests if not r.required_tools or here[r.name]]
        inv = inv.join(by_host.drop("_known"), ["host"], "left")  # one row a host
    gated = []
    for seq, r in tests:
        if host_tools is None or not r.required_tools:
            gated.append(replace(r, name=str(seq)))
        else:
            own = r.where.test if r.where is not None else r.predicate
            gated.append(replace(r, name=str(seq), predicate=own & bits.gate(r.required_tools), where=None))
    plan = first_match(inv, gated, out="_step") if gated else inv.limit(0).withColumn("_step", F.lit(None))
    plan = plan.withColumn("seq", F.col("_step").cast("long")).drop("_step")
    plan = plan.join(F.broadcast(st.select("seq", F.col("name").alias("rule"))), ["seq"], "left")  # a row each step

    listed, inputs_of = _listed(active, inputs, host_tools)
    kind = "seq bigint, rule string, input string, host string, item string, size_bytes bigint"
    rules = {seq: rule.name for seq, rule in active} or {0: ""}
    over: dict = {}  # the steps over each input, in run order
    for name, seq in inputs_of:
        over.setdefault(name, []).append(seq)
    places = tuple(sorted(set(over[name])).index(seq) for name, seq in inputs_of)
    items = _first_step([rows for _, rows in listed] or [spark.createDataFrame([], kind)], places or (0,), rules)
    if host_tools is not None:
        plan = plan.drop(*bits.columns)
    known = spark.createDataFrame([(seq, n, m) for seq, _, n, m in hosts or []],
                                  "seq bigint, hosts_applicable bigint, hosts_not_applicable bigint")

    def reported(plan: DataFrame, items: DataFrame, measured: Optional[DataFrame] = None) -> DataFrame:
        both = plan.select("seq", "size_bytes").unionByName(items.select("seq", "size_bytes"))
        report = run_report(st, reclaim_by_rule(both, rule="seq"), timings if timings is not None else measured).join(
            st.select("seq", "missing_inputs"), "seq").withColumn("freed", size_label("bytes"))
        # Where no host has a tool of the rule, it did not run, which is no error
        report = report.join(known, "seq", "left")
        nowhere = (F.col("status") == STATUS_SUCCESS) & (F.col("hosts_applicable") == 0) & (F.col("hosts_not_applicable") > 0)
        report = report.withColumns({"status": F.when(nowhere, STATUS_NOT_INSTALLED).otherwise(F.col("status")),
                                     "message": F.when(nowhere, MESSAGE_NOT_INSTALLED).otherwise(F.col("message"))})
        # D4 + E6 over the report (one row per step, so a window is right here)
        report = max_over_run(report, "bytes", out="max_bytes")
        report = max_over_run(report, "duration_s", out="max_duration_s")
        cap = F.lit(start_free_bytes // 2) if start_free_bytes is not None else F.col("max_bytes")
        report = (report.withColumn("bytes_share", share_of("bytes", F.least("max_bytes", cap)))
                  .withColumn("duration_share", share_of("duration_s", F.col("max_duration_s"))))
        return report.orderBy("seq")

    report = reported(plan, items)
    bad = unparsed({n: d for n, d in inputs.items() if any(n in s.needs for _, r in active for s in r.steps)})
    return RunResult(plan, items, report, total_of(report), reduce(DataFrame.unionByName, bad) if bad else None, reported,
                     tuple(listed), tuple(seq for seq, _ in tests), rules, places)
