"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words.  With r = target / words of the
source, every document gets floor(r) copies for certain, and the rest of the
words are a sample of fixed size with unequal probabilities: a document's
inclusion probability p falls as it gets longer (a document much shorter than
its source's mean is up to twice as likely as one much longer), and the source's
p x words add up to the words to be sampled.  Documents draw a uniform number u from a hash
and are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)).
The first in rank order are taken while the words last.  Reruns agree.

The first document that does not fit ends that, and leaves a gap smaller than
itself.  The gap is filled from the rest, by size classes (powers of two) from
large to small: of each class the first in rank order, while they fit.  At last
the document nearest to what remains is taken, if that brings the source nearer
to its target.  A source so ends nearer to its target than its smallest
document left, however long the document is that did not fit.

No source is ranked in one task: ranks fall into ``BINS`` bins, sizes are
summed by bin before the shuffle, and only the one bin of each source in which
the words run out is put in order.  Filling takes no more documents than the
gap has words, and the gap is smaller than one document: these few are an array
in their source's row.  Probabilities come from a window over the distinct
sizes of a source.  A decision is a comparison with the source's row, so a hot
source is spread like any other.  Only the sources themselves are in one window,
a row each.

Edge cases: a null text has size 0; documents of size 0 cost nothing and get the
certain copies alone; a null source is a source, last in order; a null id, and rows that
repeat source and id, are sampled row by row, by a hash of id and text and a
number among equal rows (which of equal rows gets a copy is open, how many do
is not); a source without words has target 0 and nothing of it is taken;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclaim.llm.common import WORD, stage, text_of
from reclaim.llm.ranks import ranked

MAX_COPIES, WEIGHTS = 3, (1, 2, 3)
BINS = 4096


def n_words(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def id_key(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))


def uniform(key: Column) -> Column:
    """In (0, 1): the first 52 bits of the MD5 of the key."""
    head = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10)
    return (head.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, size) -> one row a source: source, source_size, target.

    Sources in code-point order, null last, take ``weights`` in turn and share
    all words by weight; a target stops at ``max_copies`` times its source and
    the excess is shared again.  With sources in order of size over weight, the
    ones that stop come first, so one pass over running sums finds them.  Runs
    on one row a source, after the sum by source."""
    big = "decimal(38,0)"
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    by = by.withColumn("place", place)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                              F.col("place") % len(weights) + F.when(F.col("place") % len(weights) == 0, len(weights)).otherwise(0)))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w=Window.partitionBy(): F.coalesce(F.sum(c).over(w), F.lit(0)).cast(big)
    by = by.select("*", F.row_number().over(order).alias("nth"),
                   (total("source_size") - total("source_size", before) * max_copies).cast(big).alias("left"),
                   (total("weight") - total("weight", before)).cast(big).alias("weigh"))
    stops = (F.col("weight") * F.col("left")).cast(big) > (F.col("source_size").cast(big) * max_copies).cast(big) * F.col("weigh")
    by = by.withColumn("stops", stops)
    rest = F.min(F.when(~F.col("stops"), F.struct("nth", "left", "weigh"))).over(Window.partitionBy())
    share = (F.col("weight") * rest["left"]).cast("double") / rest["weigh"].cast("double")
    return by.select("source", "source_size", F.when(
        F.col("stops"), (F.col("source_size") * max_copies).cast("double")).otherwise(share).alias("target"))


def odds(key: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null where nothing is drawn, 0 where all are."""
    u = uniform(key)
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def with_odds(rows: DataFrame) -> DataFrame:
    """Rows with id key ``k`` and expected number ``copies`` -> whole (certain
    copies), p (inclusion probability), q (random odds over inclusion odds)."""
    rows = rows.withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    return rows.withColumn("q", odds(F.col("k"), F.col("p")))


def leaning(size: Column, mean: Column) -> Column:
    """What p is in proportion to, in 1024ths: from 2 for short documents down to 1 for long ones."""
    return F.floor((F.lit(1.0) + mean / (size + mean)) * 1024)


def inclusion(by_size: DataFrame, by: DataFrame) -> DataFrame:
    """(g, size, n) and (g, words) -> (g, mean, slope): p = min(1, slope x leaning)
    adds up to ``words`` over the documents of g.  With sizes in order, those that
    reach 1 come first."""
    own = Window.partitionBy("g")
    rows = by_size.filter("size > 0").withColumn("held", F.col("size") * F.col("n"))
    rows = rows.withColumn("mean", F.sum("held").over(own) / F.sum("n").over(own)).join(by.select("g", "words"), "g")
    rows = rows.withColumn("lean", leaning(F.col("size"), F.col("mean")))
    order = own.orderBy("size")
    before = F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("lean").cast("decimal(38,0)") * F.col("held")).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("slope", (F.col("words") - before) / rest.cast("double"))
    return rows.filter(F.col("slope") * F.col("lean") <= 1).groupBy("g").agg(
        F.min(F.struct("size", "mean", "slope")).alias("m")).select("g", "m.mean", "m.slope")


def units_of(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """What is taken or left: rows drawn (g, k, q, size), with the bin of their rank."""
    return stage(rows.filter("q is not null").select("g", "k", "q", "size", _bin(bins).alias("bin")), "units")


def _bin(bins: int) -> Column:
    return F.floor(F.col("q") / (1 + F.col("q")) * bins)


def _class(size: Column) -> Column:
    """The place of the highest bit."""
    return F.length(F.bin(size)) - 1


def cuts(rows: DataFrame, want: DataFrame, bins: int = BINS) -> DataFrame:
    """rows (g, k, q, size; q null: not drawn) and want (g, words) -> for each
    group g what ``is_taken`` compares a row with: the last place taken in rank
    order, the last of each size class that fills the gap, and one more."""
    units = units_of(rows, bins)
    by_bin = units.groupBy("g", "bin").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("g").orderBy("bin"))
    short = (by_bin.withColumn("upto", upto).join(want, "g").filter("upto > words")
             .groupBy("g").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("before"))).alias("edge"),
                               F.lit(0).alias("whole")))
    # a group whose words never run out is taken whole: the cut is in no bin
    edge = stage(want.join(short, "g", "left").select("g", "words", "edge.bin", "edge.before"), "edges")
    upto = F.sum("size").over(Window.partitionBy("g").orderBy("q", "k")) + F.col("before")
    inside = (units.join(edge, ["g", "bin"]).withColumn("upto", upto).filter("upto <= words")
              .groupBy("g").agg(F.max(F.struct("q", "k", "upto")).alias("last")))
    state = stage(edge.join(inside, "g", "left").select(
        "g", "bin", F.col("last.q").alias("cut_q"), F.col("last.k").alias("cut_k"),
        (F.col("words") - F.coalesce("last.upto", "before")).alias("gap")), "cuts")
    return fill(units, state, bins)


def fill(units: DataFrame, state: DataFrame, bins: int = BINS) -> DataFrame:
    """``state`` (g, bin, cut_q, cut_k, gap) -> with room (the gap), fills and extra."""
    place = F.struct("bin", "q", "k")
    left = stage(units.join(state.withColumnRenamed("bin", "cut_bin"), "g").filter(
        ~_in_order(F.col("bin"), F.col("cut_bin")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
        .select("g", "bin", "q", "k", "size", "gap", _class(F.col("size")).alias("class")), "left")
    fits = left.filter("size <= gap")
    by_bin = fits.groupBy("g", "class", "bin").agg(F.sum("size").alias("size"), F.max("gap").alias("gap"))
    before = F.sum("size").over(Window.partitionBy("g", "class").orderBy("bin")) - F.col("size")
    by_bin = by_bin.withColumn("before", before).filter("before <= gap").select("g", "class", "bin", "before")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("g", "class", "bin").orderBy("q", "k"))
    # no more rows than the gap has words
    able = fits.join(by_bin, ["g", "class", "bin"]).withColumn("upto", upto).filter("upto <= gap")
    classes = able.groupBy("g", "class").agg(F.sort_array(F.collect_list(F.struct("upto", place.alias("last")))).alias("able"))
    classes = classes.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("class", "able")), asc=False).alias("classes"))
    kind = f"array<struct<class:int,last:{units.select(place.alias('x')).schema['x'].dataType.simpleString()}>>"
    start = F.struct(F.col("gap"), F.array().cast(kind).alias("fills"))

    def down(state: Column, c: Column) -> Column:
        fit = F.filter(c["able"], lambda x: x["upto"] <= state["gap"])
        last = F.element_at(fit, -1)
        return F.when(F.size(fit) == 0, state).otherwise(F.struct(
            (state["gap"] - last["upto"]).alias("gap"),
            F.concat(state["fills"], F.array(F.struct(c["class"].alias("class"), last["last"].alias("last")))).alias("fills")))

    filled = F.aggregate(F.coalesce("classes", F.array().cast(classes.schema["classes"].dataType)), start, down)
    state = state.join(classes, "g", "left").withColumn("filled", filled)
    state = stage(state.select("g", "bin", "cut_q", "cut_k", F.col("gap").alias("room"), F.col("filled.gap").alias("gap"), "filled.fills"), "fills")
    off = F.abs(F.col("gap") - F.col("size"))
    nearest = (left.drop("gap").join(state.select("g", "room", "gap", "fills"), "g").filter(~_filled(place, F.col("class")) & (off < F.col("gap")))
               .groupBy("g").agg(F.min(F.struct(off.alias("off"), place.alias("place"))).alias("best")))
    return stage(state.join(nearest, "g", "left").select("g", "bin", "cut_q", "cut_k", "room", "fills", F.col("best.place").alias("extra")), "cuts")


def _in_order(own: Column, cut: Column) -> Column:
    """Whether a row (q, k) of the bin ``own`` comes in its group before the words run out."""
    last = (F.col("q") < F.col("cut_q")) | ((F.col("q") == F.col("cut_q")) & (F.col("k") <= F.col("cut_k")))
    return cut.isNull() | (own < cut) | ((own == cut) & F.coalesce(last, F.lit(False)))


def _filled(place: Column, size_class: Column) -> Column:
    """Whether a row that the gap had room for is among the first of its class."""
    return (F.col("size") <= F.col("room")) & F.exists("fills", lambda f: (f["class"] == size_class) & (place <= f["last"]))


def is_taken(bins: int = BINS) -> Column:
    """Whether a drawn row (q, k, size), joined to its group's cuts, is taken."""
    place = F.struct(_bin(bins).alias("bin"), "q", "k")
    more = (F.col("size") > 0) & (F.coalesce(_filled(place, _class(F.col("size"))), F.lit(False))
                                  | F.coalesce(place == F.col("extra"), F.lit(False)))
    return F.col("q").isNotNull() & (_in_order(_bin(bins), F.col("bin")) | more)


def _group(source: Column) -> Column:
    """Sources as a key without null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


class Mix:
    """The cuts of one mix of ``docs``, applied to rows of the same table."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights=WEIGHTS, max_copies: int = MAX_COPIES):
        self.id_col, self.text_col, self.source_col = id_col, text_col, source_col
        source = F.col(f"`{source_col}`").cast("string")
        plain = stage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"), *self._keys()), "sizes")
        again = plain.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or k = 'null'").select("g", "k")
        again = stage(again, "repeated")
        self.again = None if again.isEmpty() else again
        self.rows = self._told_apart(plain, text=False)
        by_size = stage(self.rows.groupBy("g", "source", "size").agg(F.count(F.lit(1)).alias("n")), "by-size")
        by = stage(source_targets(by_size.select("source", (F.col("size") * F.col("n")).alias("size")), weights, max_copies)
                   .select(_group(F.col("source")).alias("g"), "source_size", "target")
                   .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
                   .withColumn("words", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
        by = stage(by.join(inclusion(by_size, by), "g", "left"), "inclusion")
        state = cuts(self._drawn(self.rows.join(by, "g")), by.select("g", "words"))
        # a table of its own, so that Spark sees how small it is and need not shuffle the texts to meet it
        self.cuts = stage(by.drop("words").join(state, "g"), "sources")

    def _keys(self) -> list[Column]:
        """g, k (the id), t (a hash of the text) and size of a row of the documents."""
        return [_group(F.col(f"`{self.source_col}`").cast("string")).alias("g"), id_key(self.id_col).alias("k"),
                F.md5(text_of(self.text_col).cast("binary")).alias("t"), n_words(self.text_col).alias("size")]

    def _told_apart(self, rows: DataFrame, text: bool) -> DataFrame:
        """``rows`` with a ``k`` that no other row of the source has."""
        if self.again is None:
            return rows.drop("t")
        same = rows.join(self.again, ["g", "k"], "left_semi").withColumn("_same", F.concat_ws(":", "g", "k", "t"))
        same = ranked(stage(same, "repeated-rows", text=text), "_same", [], "numbers")
        same = same.withColumn("k", F.concat_ws(":", "k", "t", F.col("rank").cast("string")))
        return rows.join(self.again, ["g", "k"], "left_anti").drop("t").unionByName(same.select([c for c in rows.columns if c != "t"]))

    @staticmethod
    def _drawn(rows: DataFrame) -> DataFrame:
        """Rows joined to their source's row, with p and q."""
        p = F.least(F.lit(1.0), F.col("slope") * leaning(F.col("size"), F.col("mean")))
        rows = rows.withColumn("p", F.when(F.col("size") > 0, F.coalesce(p, F.lit(0.0))).otherwise(F.lit(0.0)))
        return rows.withColumn("q", odds(F.col("k"), F.col("p")))

    def _decided(self, rows: DataFrame) -> DataFrame:
        """rows with g, k and size -> with source_size, target and n_copies."""
        return self._drawn(rows.join(self.cuts, "g")).withColumn("n_copies", F.col("whole") + is_taken().cast("long"))

    def decisions(self) -> DataFrame:
        """doc_id, size, source_size, target, n_copies, taken: a row for each row."""
        return self._decided(self.rows).select(
            "doc_id", "size", "source_size", "target", "n_copies", (F.col("n_copies") * F.col("size")).alias("taken"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs``, each row as often as the mix takes it."""
        rows = docs.select(*self._keys(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
        copies = self._decided(self._told_apart(rows, text=True)).filter("n_copies > 0")
        return copies.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("n_copies").cast("int")))).select("_row.*")
