"""Exact dedup by deterministic block naming (DataFrame functions only).

Every text is cut into blocks of a fixed number of characters.  Equal blocks
get one integer name, the place of the block in the sorted list of blocks;
then adjacent names are named in pairs, again by sorting, until every document
is left with one name.  Two documents have the same name exactly if they have
the same text, since names are given by comparing contents, never by a hash
alone.

What keeps this small at scale: a 64-bit hash of each block is counted first.
A document with a block whose hash occurs nowhere else has no copy, so only
documents all of whose blocks are shared are named.  Of blocks with the same
hash only the distinct contents are sorted, after a map-side distinct.

Edge cases: a null text counts as empty; empty texts are equal to each other;
white space at the ends counts as one space; of rows that repeat a doc_id and
its text one is kept; a null doc_id comes after every other; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclaim.llm.common import SPACE, keep_rows, stage, text_of

BLOCK_CHARS = 16384


def normalised(text_col: str) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text_of(text_col), SPACE, " ")


def _sorted_names(distinct: DataFrame, order: list[str], split: list[str], label: str) -> DataFrame:
    """Give each row of ``distinct`` an integer name in sort order.  The name is
    the row's place in its range partition; writing the table fixes it.  The
    ranges are found from ``split``, the leading columns, so that their sample
    holds no block texts."""
    ranged = distinct.repartitionByRange(*split).sortWithinPartitions(*order)
    return stage(ranged.withColumn("name", F.monotonically_increasing_id()), label, text="block" in order)


def _block_names(blocks: DataFrame) -> DataFrame:
    """(row, idx, h, block) -> (row, idx, name), equal names for equal blocks."""
    names = _sorted_names(blocks.select("h", "block").distinct(), ["h", "block"], ["h"], "names")
    alone = stage(names.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")), "hashes")
    # one block to a hash, as good as always: the hash stands for it
    named = blocks.select("row", "idx", "h").join(alone.filter("n = 1").drop("n"), "h").select("row", "idx", "name")
    clash = alone.filter("n > 1").select("h")
    if not clash.isEmpty():
        same = blocks.join(clash, "h").join(names, ["h", "block"]).select("row", "idx", "name")
        named = named.union(same)
    return named


def name_documents(rows: DataFrame) -> DataFrame:
    """(row, blocks, hashes) -> (row, level, name): rows with the same level
    and name have the same text.  Rows that cannot have a copy are left out."""
    cells = rows.select("row", F.posexplode("hashes").alias("idx", "h"))
    shared = cells.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    counted = cells.join(shared.withColumn("hit", F.lit(1)), "h", "left").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("hit").alias("hits"))
    whole = stage(counted.filter("hits = n_blocks").select("row", "n_blocks"), "candidates")
    # texts move by row at every size: one plan, whether the candidates are few or many
    blocks = stage(rows.join(whole.hint("merge"), "row").select(
        "row", F.posexplode(F.arrays_zip("hashes", "blocks")).alias("idx", "b"))
        .select("row", "idx", F.col("b.hashes").alias("h"), F.col("b.blocks").alias("block")), "blocks", text=True)
    level, done = 0, []
    names = stage(_block_names(blocks).join(whole, "row"), "level")
    longest = whole.agg(F.max("n_blocks")).first()[0] or 0
    while longest > 1:
        done.append(names.filter("n_blocks = 1").select("row", F.lit(level).alias("level"), "name"))
        half = F.shiftright("idx", 1)
        pairs = stage(names.filter("n_blocks > 1").groupBy("row", "n_blocks", half.alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("l"),
            F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("r"))
            .withColumn("n_blocks", F.shiftright(F.col("n_blocks") + 1, 1))
            .withColumn("r", F.coalesce("r", F.lit(-1))), "pairs")
        new = _sorted_names(pairs.select("l", "r").distinct(), ["l", "r"], ["l", "r"], "names")
        names = stage(pairs.join(new, ["l", "r"]).select("row", "idx", "n_blocks", "name"), "level")
        level, longest = level + 1, (longest + 1) // 2
    out = names.select("row", F.lit(level).alias("level"), "name")
    for d in done:
        out = out.union(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS, block_hash=F.xxhash64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept and
    text_sha256 of the normalised text.  ``block_hash`` (a function from a
    column to a bigint column) only pre-sorts blocks; any function gives the
    same result."""
    text = normalised(text_col)
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{int(block_chars)}}}"), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), cut.alias("blocks"))
    rows = rows.withColumn("blocks", F.when(F.size("blocks") == 0, F.array(F.lit(""))).otherwise(F.col("blocks")))
    rows = stage(rows.withColumn("hashes", F.transform("blocks", lambda b: block_hash(b)))
                 .withColumn("row", F.monotonically_increasing_id()), "texts", text=True)
    ids = rows.select("row", "doc_id", "text_sha256")
    named = name_documents(rows).join(ids, "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    groups = named.groupBy("level", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    copies = named.join(groups, ["level", "name"]).select(
        "row", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    out = ids.join(copies, "row", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies: of equal texts the row with the smallest id stays."""
    kept = (exact_dedup(docs, id_col, text_col).filter("kept")
            .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_t")))
    return keep_rows(docs, kept, id_col, F.sha2(normalised(text_col), 256))
