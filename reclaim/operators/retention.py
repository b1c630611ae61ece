"""Retention operators E1-E5, F3, C4.

"Keep the newest N" (E1, F3) and "keep the newest until a byte budget is spent"
(E4) come down to one cut per group: a place in the order (time, tiebreak).  A
row is dropped by comparing its own place with the cut, so the rows themselves
are never gathered by group.  How the cut is found:

* E1: the newest n of each group by ``row_number() <= n``.  Spark turns this into
  a limit of n rows a group in every map task, so a group that holds a third of
  all rows sends n rows a task.
* F3: the newest n of all by a top-n, read back as a scalar.
* E4: a radix descent over the composite key (time, then the tiebreak, texts in
  pieces of 7 bytes).  Each level sums weights by at most 2^16 bins of what the
  level above left of a group, finds the bin in which the budget is passed, and
  goes on in it; two fixed levels over the time, then levels that look for the
  first part of the key that still varies and split its range.  Rows are put in
  order only within the last bin.  The input is read three times: for the
  sums over time, for the rows of the one bin left, and to mark the rows.

All of these are one lazy plan for inputs of any size: no job runs before an action.
Rows that tie with the last kept row in time and tiebreak are kept with it.
"Newest per key" by a version (E2, E3) is a max per key, also partial; E2 ranks
the versions first, which runs a job.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclaim.functions.paths import _c
from reclaim.operators.order import global_row_number

_LOWEST = -(2 ** 62)
_TIMES, _WHOLE = ("timestamp", "timestamp_ntz", "date"), ("byte", "short", "integer", "long")
_TEXTS = ("string", "char", "varchar", "binary")
#: Bins a level, and the numbers of 7 bytes that a text tiebreak is compared by before rows are.
FANOUT_BITS, TEXT_PARTS = 16, 8
#: The parts that a bin's rows are dealt over where they meet the bin of their group.
SPREAD = 16


def _keys(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where null equals null (a null key is a group of
    its own, as in a window ``PARTITION BY``); the right side's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"_rk_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])


def _place(ts: str, tiebreak: str) -> Column:
    """A row's place in the order, to be compared as a whole; null is oldest."""
    return F.struct(F.col(ts).alias("ts"), F.col(tiebreak).alias("tie"))


def _order_value(df: DataFrame, ts: str) -> Column:
    """A whole number that never falls as ``ts`` grows: microseconds of times,
    whole numbers as they are, others in units of 2^-20; null lowest."""
    kind = df.schema[ts].dataType.typeName()
    if kind in _TIMES:
        v = F.unix_micros(F.col(ts).cast("timestamp"))
    elif kind in _WHOLE:
        v = F.col(ts).cast("long")
    else:
        v = F.floor(F.col(ts).cast("double") * 2 ** 20).cast("long")
    return F.coalesce(F.greatest(v, F.lit(_LOWEST + 1)), F.lit(_LOWEST))


def _tie_parts(kind: str, tie: Column) -> list[Column]:
    """Whole numbers that, compared one after the other, never fall as a tiebreak
    of this type grows: the number itself, or a text's bytes, 7 to a number."""
    if kind in _WHOLE or kind in _TIMES:
        # half of it, which leaves a number below all for null; its last bit is left to the rows' own order
        whole = F.unix_micros(tie.cast("timestamp")) if kind in _TIMES else tie.cast("long")
        return [F.coalesce(F.shiftright(whole, 1), F.lit(_LOWEST - 1))]
    if kind not in _TEXTS:
        return [F.lit(0).cast("long")]
    return [F.when(tie.isNull(), F.lit(_LOWEST)).otherwise(F.conv(
        F.rpad(F.hex(F.substring(tie.cast("binary"), 7 * i + 1, 7)), 14, "0"), 16, 10).cast("long")) for i in range(TEXT_PARTS)]


def _passed(sums: DataFrame, keys: list[str], bins: list[str], budget: int, more: Sequence[str] = ()) -> DataFrame:
    """sums (keys, bins, _bw, _start: weight of newer bins of the level above) ->
    per group the bin in which the budget is passed and the weight before it."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(b).desc() for b in bins]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    after = F.col("_start") + F.sum("_bw").over(w)
    return (sums.withColumn("_after", after)
            .withColumn("_start", F.col("_after") - F.col("_bw"))
            .filter((F.col("_after") > F.lit(budget)) & (F.col("_start") <= F.lit(budget)))
            .select(*keys, *bins, "_start", *more))


def _radix_bin(parts: Sequence[Column], low: Sequence[Column], high: Sequence[Column], bits: int) -> Column:
    """The bin of a row in a group whose parts run from ``low`` to ``high``: by the
    first part that varies, at most 2^bits + 1 bins over its range; 0 where none does."""
    out = F.lit(0).cast("long")
    for part, lo, hi in reversed(list(zip(parts, low, high))):
        # in doubles, since the range of 64-bit numbers may itself have 65 bits
        width = F.ceil(F.log2(hi.cast("double") - lo.cast("double") + 1)).cast("int")
        shift = F.greatest(width - bits, F.lit(0))
        out = F.when(lo < hi, F.call_function("shiftright", part, shift) - F.call_function("shiftright", lo, shift)).otherwise(out)
    return out


def _within(rows: DataFrame, cut: DataFrame, keys: list[str], one_group: bool) -> DataFrame:
    """Inner join of ``rows`` with the one bin of each group.  A bin may hold all rows
    of its group (one time, or texts that start alike), so they are dealt over parts by
    their place, and the bin is there once a part.  The bin of a single group is one
    row, which goes to the rows."""
    if one_group:
        return join_on_keys(rows, F.broadcast(cut), keys, "inner")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_p"), F.lit(SPREAD)))
    each = cut.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return join_on_keys(dealt, each, [*keys, "_part"], "inner").drop("_part")


def budget_cut(df: DataFrame, keys: list[str], ts: str, budget: int, weight: Column, tiebreak: str,
               levels: int, bits: int, one_group: bool = False) -> DataFrame:
    """keys and ``_cut``: the places of the first row dropped and the last kept, for
    groups whose budget is passed; ``one_group``: the keys have the same values in every row.

    Every table used twice is used with all its columns both times: so Spark plans
    one shuffle of it, and reads what is below it once."""
    g, kind = keys, df.schema[tiebreak].dataType.typeName()
    rows = df.select(*g, _place(ts, tiebreak).alias("_p"), weight.alias("_w"), _order_value(df, ts).alias("_v"))
    # any time Spark can hold falls into less than 2^16 coarse bins, each with 2^16 fine ones
    high = 44 if df.schema[ts].dataType.typeName() in _TIMES else 48
    fine, coarse = F.shiftright("_v", high - 16), F.shiftright("_v", high)

    head = _tie_parts(kind, F.col("_p.tie"))[0]
    by_fine = rows.select("*", head.alias("_t")).groupBy(*g, coarse.alias("_c"), fine.alias("_f")).agg(
        F.sum("_w").alias("_bw"), F.min("_v").alias("_lo_v"), F.max("_v").alias("_hi_v"), F.min("_t").alias("_lo_t"), F.max("_t").alias("_hi_t"))
    by_coarse = by_fine.groupBy(*g, "_c").agg(
        F.sum("_bw").alias("_bw"), F.lit(0).cast("long").alias("_start"), F.min("_lo_v").alias("_least"),
        F.max("_hi_v").alias("_most"), F.min("_lo_t").alias("_least_t"), F.max("_hi_t").alias("_most_t"))
    cut = _passed(by_coarse, g, ["_c"], budget, ["_least", "_most", "_least_t", "_most_t"])
    known = F.col("_lo_v").between(F.col("_least"), F.col("_most")) & F.col("_hi_t").between(F.col("_least_t"), F.col("_most_t"))
    ranges = ["_lo_v", "_hi_v", "_lo_t", "_hi_t"]
    cut = _passed(join_on_keys(by_fine, cut, [*g, "_c"], "inner").filter(known & (F.col("_lo_t") <= F.col("_hi_t"))),
                  g, ["_c", "_f"], budget, ranges).drop("_c")
    # the rows of one fine bin a group, each with the ranges that the next level splits
    inside = _within(rows.withColumn("_f", fine), cut, [*g, "_f"], one_group).drop("_f")
    parts = lambda p: [F.col("_v"), *_tie_parts(kind, p)]
    low, top = [F.col("_lo_v"), F.col("_lo_t")], [F.col("_hi_v"), F.col("_hi_t")]
    for level in range(levels):
        inside = inside.repartition(*g, "_p")
        row_bin = _radix_bin(parts(F.col("_p.tie")), low, top, bits)
        binned = inside.select(*g, "_p", "_w", "_v", "_start", row_bin.alias("_b"))
        sums = binned.groupBy(*g, "_b").agg(F.sum("_w").alias("_bw"), F.min("_start").alias("_start"),
                                            F.min(F.struct("_v", "_p")).alias("_lo"), F.max(F.struct("_v", "_p")).alias("_hi"))
        cut = _passed(sums, g, ["_b"], budget, ["_lo", "_hi"]).withColumnRenamed("_start", "_before")
        inside = _within(binned, cut, [*g, "_b"], one_group)
        # the weight of newer rows, once as known above and once with this level's
        inside = inside.withColumn("_start", F.greatest("_start", "_before")).drop("_b", "_before")
        low, top = ([F.col(f"{e}._v"), *_tie_parts(kind, F.col(f"{e}._p.tie"))] for e in ("_lo", "_hi"))
    run = F.col("_start") + F.sum("_w").over(Window.partitionBy(*g).orderBy(F.col("_p").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    edge = inside.select(*g, "_p", run.alias("_run"))
    over = F.col("_run") > F.lit(budget)
    cut = edge.groupBy(*g).agg(F.max(F.when(over, F.col("_p"))).alias("_first"),
                               F.min(F.when(~over, F.col("_p"))).alias("_last"))
    return cut.select(*g, F.struct("_first", "_last").alias("_cut"))


def over_budget(df: DataFrame, keys: Sequence[str] | str | None, ts: str, budget: int,
                weight: str | Column | None = None, tiebreak: str = "id", out: str = "drop",
                levels: int | None = None, bits: int = FANOUT_BITS) -> DataFrame:
    """Add boolean ``out``: the row's running weight (newest first by ``ts``
    then ``tiebreak``, nulls oldest, itself included) is greater than ``budget``.

    ``weight`` None counts rows; null weights count 0, none may be negative.
    Rows equal in ``ts`` and ``tiebreak`` are kept together if one of them is.

    ``levels`` levels of 2^bits bins follow the two over the time: one, or two where
    the tiebreak is a text, whose first bytes are often the same.  Each divides the
    rows that are put in order at last: one level leaves of one time with 2^32
    evenly spread ids 2^16 rows.  More levels suit keys that crowd together more
    unevenly than that; the answer is the same."""
    keys = _keys(keys)
    w = F.lit(1).cast("long") if weight is None else F.coalesce(_c(weight), F.lit(0)).cast("long")
    if levels is None:
        levels = 2 if df.schema[tiebreak].dataType.typeName() in _TEXTS else 1
    if keys:
        marked = join_on_keys(df, budget_cut(df, keys, ts, budget, w, tiebreak, levels, bits), keys, "left")
    else:  # at most one row: read as a scalar, no join
        cut = budget_cut(df.withColumn("_g", F.lit(0)), ["_g"], ts, budget, w, tiebreak, levels, bits, one_group=True)
        marked = df.withColumn("_cut", cut.select("_cut").scalar())
    place, first, last = _place(ts, tiebreak), F.col("_cut._first"), F.col("_cut._last")
    dropped = (place < first) | ((place == first) & ~first.eqNullSafe(last))
    return marked.withColumn(out, F.coalesce(dropped, F.lit(False))).drop("_cut")


def drop_all_but_latest(df: DataFrame, keys, ts: str, n: int, tiebreak: str = "id") -> DataFrame:
    """Rows beyond the newest ``n`` in each group (``sort | head -n -n``)."""
    keys = _keys(keys)
    if not keys:
        return drop_last_n(df, ts, n, tiebreak)
    if n <= 0:
        return df
    p = _place(ts, tiebreak)
    newest = df.select(*keys, p.alias("_p")).withColumn("_nth", F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col("_p").desc()))).filter(F.col("_nth") <= n)
    last = newest.groupBy(*keys).agg(F.min("_p").alias("_last"))
    return join_on_keys(df, last, keys, "inner").filter(_place(ts, tiebreak) < F.col("_last")).drop("_last")


def drop_last_n(df: DataFrame, ts: str, n: int, tiebreak: str = "id") -> DataFrame:
    """global "all but the newest n": a top-n (``TakeOrderedAndProject``),
    whose oldest place is the cut, read as a scalar."""
    if n <= 0:
        return df
    newest = df.select(_place(ts, tiebreak).alias("_p")).orderBy(F.col("_p").desc()).limit(n)
    return df.filter(_place(ts, tiebreak) < newest.agg(F.min("_p")).scalar())


def superseded(df: DataFrame, keys, version: Column, tiebreak: str = "id") -> DataFrame:
    """Every version but the newest of each key; of equal versions the one with
    the greatest ``tiebreak`` is the newest, a null version or tiebreak the oldest.

    Versions are texts, whose max per key Spark can only find by sorting.  So the
    distinct versions are put in order first, all together and in many tasks
    (``global_row_number``, which runs a job), and the newest is a max of whole
    numbers per key, combined before the shuffle.  A key with a third of all
    rows is a row a task."""
    keys = _keys(keys)
    v = df.withColumn("_v", version)
    ranks = global_row_number(v.select("_v").filter("_v is not null").distinct(), [F.col("_v")], out="_rank")
    v = v.join(ranks, ["_v"], "left").withColumn("_rank", F.coalesce("_rank", F.lit(0).cast("long"))).drop("_v")
    newest = v.groupBy(*keys).agg(F.max("_rank").alias("_newest"))
    v = join_on_keys(v, newest, keys, "inner")
    last = v.filter(F.col("_rank") == F.col("_newest")).groupBy(*keys).agg(F.max(tiebreak).alias("_last"))
    older = (F.col("_rank") < F.col("_newest")) | F.coalesce(F.col(tiebreak) < F.col("_last"), F.col("_last").isNotNull() & F.col(tiebreak).isNull())
    return join_on_keys(v, last, keys, "inner").filter(older).drop("_rank", "_newest", "_last")


def before_current(df: DataFrame, keys, version: Column, is_current: Column) -> DataFrame:
    """In version order, everything before the current version of each key
    (``sort -V | sed '/cur/q;p'``).  No current row in a key -> nothing dropped."""
    keys = _keys(keys)
    v = df.withColumn("_v", version).withColumn("_is_cur", is_current)
    # only current rows feed the aggregate, so its (sort-based, string) min
    # sees a handful of rows per key, not the whole table
    cur = v.filter(F.col("_is_cur")).groupBy(*keys).agg(F.min("_v").alias("_cur"))
    return (join_on_keys(v, cur.filter(F.col("_cur").isNotNull()), keys, "inner")
            .filter(F.col("_v") < F.col("_cur"))
            .drop("_v", "_is_cur", "_cur"))


def unreferenced(items: DataFrame, refs: DataFrame, keys) -> DataFrame:
    """C4: items nothing refers to.  A null key is never referenced; a key
    referenced twice does not duplicate rows (anti-join).

    The reference keys are deduplicated first (a map-side partial aggregate),
    so a key referenced by a third of all rows is one row per task on the
    build side; skew on the item side is split by AQE.  A hash leads the keys, as
    the sort before the join compares by the start of the first key, and that of
    a host or a name is the same for many."""
    keys = _keys(keys)
    by = lambda df: df.withColumn("_h", F.xxhash64(*keys))
    return by(items).join(by(refs.select(*keys).distinct()), ["_h", *keys], "left_anti").drop("_h")


def freed_between(readings: DataFrame, keys, seq: str, reading: str, out: str = "freed") -> DataFrame:
    """E5: amount freed between consecutive readings of free space, floored at 0
    (the first reading of a key frees 0).

    The reading before is the one before in the row's fine bin of the order (as
    in E4), else the last of the nearest earlier fine bin in its coarse bin, else
    the last of the nearest earlier coarse bin.  So no window holds more than
    one fine bin's rows or one level's bins, however large a key is."""
    keys = _keys(keys)
    g = keys or ["_g"]
    rows = readings if keys else readings.withColumn("_g", F.lit(0))
    v = _order_value(readings, seq)
    rows = rows.withColumn("_f", F.shiftright(v, 20)).withColumn("_c", F.shiftright(v, 40))
    here = F.struct(F.col(seq).alias("at"), F.col(reading).alias("value"))
    last_f = rows.groupBy(*g, "_c", "_f").agg(F.max(here).alias("_last"))
    last_c = last_f.groupBy(*g, "_c").agg(F.max("_last").alias("_last"))
    before_c = last_c.select(*g, "_c", F.lag("_last").over(Window.partitionBy(*g).orderBy("_c")).alias("_prev_c"))
    before_f = last_f.select(*g, "_c", "_f", F.lag("_last").over(
        Window.partitionBy(*g, "_c").orderBy("_f")).alias("_prev_f"))
    before = join_on_keys(before_f, before_c, [*g, "_c"], "inner").select(
        *g, "_c", "_f", F.coalesce("_prev_f", "_prev_c").alias("_prev_bin"))
    own = F.lag(here).over(Window.partitionBy(*g, "_c", "_f").orderBy(seq))
    rows = join_on_keys(rows.withColumn("_prev", own), before, [*g, "_c", "_f"], "inner")
    prev = F.coalesce("_prev", "_prev_bin")["value"]
    freed = F.greatest(F.coalesce(F.col(reading) - prev, F.lit(0)), F.lit(0))
    return rows.withColumn(out, freed).drop("_g", "_f", "_c", "_prev", "_prev_bin")
