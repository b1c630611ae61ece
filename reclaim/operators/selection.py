"""Rule selection and gates: C5 (include / exclude / all), C6 (unknown names),
C7 (tool present on the host), C8 (approval), F1 (catalogue order), G2 (difference).

These work on the rule table, whose size is the number of registered rules;
the data-sized work is the per-host gate of C7, which joins the inventory with
a per-host capability row.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reclaim.functions.text import is_yes


class SelectionError(ValueError):
    pass


def check_mode(include: str = "", exclude: str = "", all_rules: bool = False) -> str:
    """Exactly one of the three ways to select rules."""
    if exclude and include:
        raise SelectionError("choose rules by inclusion or by exclusion, not by both")
    if all_rules and (exclude or include):
        raise SelectionError("a run of all rules takes no list of names")
    if not all_rules and not exclude and not include:
        raise SelectionError("no rules were chosen")
    return "all" if all_rules else ("include" if include else "exclude")


def selected_names(names: Sequence[str], include: str = "", exclude: str = "", all_rules: bool = False) -> list[str]:
    """C5 on the driver, where the rule book is: the names to run, in run order
    (a name given twice is twice there)."""
    mode = check_mode(include, exclude, all_rules)
    asked = [] if mode == "all" else (include or exclude).split(",")
    for name in asked:
        if name not in names:
            raise SelectionError(f"no rule is called {name}")
    return asked if mode == "include" else [n for n in sorted(names) if n not in asked]


def answers(names: Sequence[str], given: Iterable[tuple]) -> list[Optional[str]]:
    """The answer for each step of a run.  ``given`` are pairs (name, answer): one
    answer for a name holds for all its steps, as many as steps go to them in
    order, any other number is an error.  (position from 1, answer) answers one
    step."""
    by_name: dict[str, list] = {}
    by_step: dict[int, str] = {}
    for who, what in given:
        if isinstance(who, int):
            if who in by_step:
                raise SelectionError(f"step {who} was answered twice")
            by_step[who] = what
        else:
            by_name.setdefault(who, []).append(what)
    out = []
    for i, name in enumerate(names):
        mine = by_name.get(name, [None])
        if len(mine) not in (1, list(names).count(name)):
            raise SelectionError(f"{len(mine)} answers for the steps of {name}")
        nth = list(names[:i]).count(name)
        out.append(by_step.get(i + 1, mine[nth] if len(mine) > 1 else mine[0]))
    return out


def requested(spark: SparkSession, arg: str) -> DataFrame:
    """``(pos, name)`` of a comma-separated argument; names are not trimmed."""
    return (spark.createDataFrame([(arg,)], "arg string")
            .select(F.posexplode(F.split("arg", ",")).alias("pos", "name")))


def unknown_names(req: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requested names missing from the catalogue (case-sensitive)."""
    return req.join(catalogue.select("name"), ["name"], "left_anti")


def _fail_on_unknown(req: DataFrame, catalogue: DataFrame) -> None:
    first = unknown_names(req, catalogue).orderBy("pos").limit(1).collect()
    if first:
        raise SelectionError(f"no rule is called {first[0]['name']}")


def ordered_catalogue(catalogue: DataFrame) -> DataFrame:
    """``(seq, name)`` in byte order.  The window is over the rule table."""
    return catalogue.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("seq"),
                            "name")


def select_rules(spark: SparkSession, catalogue: DataFrame, include: str = "", exclude: str = "",
                 all_rules: bool = False) -> DataFrame:
    """``(seq, name)`` of the rules to run, in run order.

    include: the given names in the given order, duplicates kept.
    exclude: sorted names minus the given set (G2).  all: sorted names.
    Unknown names raise :class:`SelectionError` naming the first one.
    """
    mode = check_mode(include, exclude, all_rules)
    if mode == "all":
        return ordered_catalogue(catalogue)
    req = requested(spark, include or exclude)
    _fail_on_unknown(req, catalogue)
    if mode == "include":
        return req.select((F.col("pos") + 1).cast("long").alias("seq"), "name")
    return ordered_catalogue(catalogue.join(req.select("name"), ["name"], "left_anti"))


def approval_gate(selected: DataFrame, catalogue: DataFrame, approvals: DataFrame,
                  on: Sequence[str] = ("name",)) -> DataFrame:
    """Rules needing consent are skipped unless the answer lower-cases to
    ``y``; rules that need none run.  Adds ``skipped`` (boolean).  Two answers
    for one key are an error when the result is computed: rows never multiply."""
    twice = F.raise_error(F.concat(F.lit("more than one answer for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in on])))
    a = approvals.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first("ans").alias("ans")).select(
        *on, F.when(F.col("_n") > 1, twice.cast("string")).otherwise(F.col("ans")).alias("ans"))
    return (selected.join(catalogue.select("name", "requires_approval"), ["name"], "left")
            .join(a, list(on), "left")
            .withColumn("skipped", F.coalesce(F.col("requires_approval"), F.lit(False)) & ~is_yes("ans"))
            .drop("ans"))


def host_capabilities(host_tools: DataFrame) -> DataFrame:
    """``(host, tools ARRAY<STRING>)``: one row per host; the array is bounded by
    the number of known tools, not by data."""
    return host_tools.groupBy("host").agg(F.array_sort(F.collect_set("tool")).alias("tools"))


def tool_gate(required_tools: Sequence[str], tools: str = "tools") -> Column:
    """C7 per row: the host's tool array holds one of ``required_tools``
    (true when the rule needs none)."""
    if not required_tools:
        return F.lit(True)
    need = F.array(*[F.lit(t) for t in required_tools])
    return F.coalesce(F.arrays_overlap(F.col(tools), need), F.lit(False))


def with_host_tools(inventory: DataFrame, host_tools: DataFrame, tools: str = "tools") -> DataFrame:
    """Attach the host's tool array to every inventory row (left join on host;
    one row per host on the right, so AQE broadcasts it for any real fleet)."""
    caps = host_capabilities(host_tools).withColumnRenamed("tools", tools)
    return inventory.join(caps, ["host"], "left")


# ------------------------------------------------------- tools as bitmaps
_WORD_BITS = 62


class ToolBits:
    """The tools that rules name, each a bit of the host's bitmaps.

    ``hosts`` has one row a host: as many bigint columns as the tools fill, 62 to
    each, from one ``bit_or`` (combined before the shuffle).  A rule's gate is an
    AND with a literal, whatever the number of tools on the host."""

    def __init__(self, tools: Iterable[str]):
        self.place = {t: i for i, t in enumerate(sorted(set(tools)))}
        self.columns = [f"_tools{i}" for i in range(-(-len(self.place) // _WORD_BITS))]

    def _mask(self, tools: Iterable[str], word: int) -> int:
        return sum(1 << self.place[t] % _WORD_BITS for t in set(tools) if self.place[t] // _WORD_BITS == word)

    def hosts(self, host_tools: DataFrame) -> DataFrame:
        """(host, tool) -> host and its bitmaps; hosts with none of the tools have zeros."""
        at = F.create_map(*[F.lit(x) for t, i in self.place.items() for x in (t, i)]) if self.place else None
        rows = host_tools.withColumn("_at", F.element_at(at, F.col("tool")) if self.place else F.lit(None).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_at", F.lit(_WORD_BITS)))
        return rows.groupBy("host").agg(F.lit(1).alias("_known"), *[
            F.coalesce(F.bit_or(F.when(F.floor(F.col("_at") / _WORD_BITS) == i, bit)), F.lit(0).cast("long")).alias(c)
            for i, c in enumerate(self.columns)])

    def gate(self, tools: Iterable[str]) -> Column:
        """Whether a host has any of ``tools`` (true where none is needed)."""
        tools = list(tools)
        if not tools:
            return F.lit(True)
        hit = F.lit(False)
        for i, c in enumerate(self.columns):
            if mask := self._mask(tools, i):
                hit = hit | (F.coalesce(F.col(c), F.lit(0)).bitwiseAND(F.lit(mask)) != 0)
        return hit


def applicable_rules(steps: Sequence[tuple], hosts: DataFrame, bits: ToolBits) -> list[tuple[int, int]]:
    """For each of ``steps`` (a tuple of tool sets; the step applies where any of
    the sets does) the number of hosts it applies to, and of those it does not.
    One row of sums comes to the driver, two numbers a step."""
    able = [reduce(lambda a, b: a | b, [bits.gate(t) for t in sets]) if sets else F.lit(True) for sets in steps]
    sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"s{i}") for i, c in enumerate(able)]
    row = hosts.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return [(row[f"s{i}"], row["n"] - row[f"s{i}"]) for i in range(len(steps))]
