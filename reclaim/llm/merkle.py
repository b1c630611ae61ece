"""Merkle manifest of a dataset by nested-struct rollup.

A leaf is the digest of one row; the leaves of a source, in order of doc_id, are
folded three at a time into the source's subroot, and the subroots, in order of
source, into the root.  The place of a node in its source is written in digits
of base 3.  The digits of one bounded block (``BLOCK_LEVELS`` of them, 729
nodes) are grouped away one after the other, each time nesting the children as
structs in their parent, so a block ends as one row that holds its whole
subtree.  All of that needs one shuffle, by block: the later groupings find
their rows in place.  The blocks' digests are the nodes of the next layer, until
a source has one block; subroots go through the same layers.

Proofs go down the same way.  A block row that has the path above it unfolds its
tree with ``transform`` and ``explode`` into its nodes, each with its own path: the
siblings to the left and right, level by level.  The path above reaches a block
by grouping the two rows of the block, so no join moves documents or digests.

A row costs the shuffle its id, its source and two digests, never its text, and
each text is read once.  A block row holds 729 nodes at any size; a proof grows with the
logarithm of the table.  Layers: one more for every 729-fold of a source.

Edge cases: nulls are written as ``-``; a null text, source, lang, n_chars or
doc_id is so told apart from an empty one; a null doc_id comes first in its source and is never
tampered with; rows that repeat a doc_id are in order of their leaves, rows equal in all
fields have equal leaves and any order of them gives the same result; a source
with one row has its leaf as subroot, a table with one source its subroot as
root; very long texts are hashed whole; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reclaim.llm.common import stage
from reclaim.llm.ranks import ranked

ARITY, BLOCK_LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: The way from a node to the top: at each level the digests of its siblings,
#: those before it and those after it, written one after the other.
PATH = "array<struct<l:string,r:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value in a form from which it can be told where it ends."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def fold(start: Column, path: Column) -> Column:
    """The digest at the top of ``path`` for the digest ``start`` at its foot."""
    return F.aggregate(path, start, lambda d, step: digest(F.concat(step["l"], d, step["r"])))


# ------------------------------------------------------------------ upwards
def _active(level: int, arity: int) -> Column:
    """Whether nodes are folded at this level: more than one was left below it."""
    return F.col("n") > arity ** (level - 1)


def roll_up(nodes: DataFrame, payload: Sequence[str], label: str, arity: int, levels: int) -> DataFrame:
    """nodes (g, rank, n, digest, payload) -> one row for each block of
    ``arity ** levels`` nodes: g, block, n (nodes of the group), digest, kids."""
    digits = [f"_d{i}" for i in range(1, levels + 1)]
    out = nodes.select("g", "n", F.floor(F.col("rank") / arity ** levels).cast("long").alias("block"), "digest", *payload, *[
        F.pmod(F.floor(F.col("rank") / arity ** i), F.lit(arity)).cast("int").alias(d) for i, d in enumerate(digits)])
    out = out.repartition("g", "block")
    below = ["digest", *payload]
    for level, d in enumerate(digits, 1):
        out = out.groupBy("g", "block", *digits[level:]).agg(
            F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(d).alias("d"), *below))).alias("kids"))
        out = out.withColumn("digest", F.when(_active(level, arity), digest(F.array_join(F.col("kids")["digest"], "")))
                             .otherwise(F.col("kids")[0]["digest"]))
        below = ["digest", "kids"]
    return stage(out.select("g", "block", "n", "digest", "kids"), label)


def layers(nodes: DataFrame, payload: Sequence[str], label: str, arity: int, levels: int) -> list[DataFrame]:
    """Block tables from the nodes up, the last with one block for each group."""
    out = [roll_up(nodes, payload, label, arity, levels)]
    while (out[-1].agg(F.max("block")).first()[0] or 0) > 0:
        up = out[-1].select("g", F.col("block").alias("rank"), F.ceil(F.col("n") / arity ** levels).alias("n"), "digest")
        out.append(roll_up(up, [], label, arity, levels))
    return out


# ---------------------------------------------------------------- downwards
def _unfold(level: int, arity: int):
    """From nodes (path, rank, kids) to their children, with paths one step longer."""
    def children(node: Column) -> Column:
        kids = node["kids"]

        def child(kid: Column, i: Column) -> Column:
            digests = kids["digest"]
            step = F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("l"),
                            F.array_join(F.slice(digests, i + 2, F.lit(arity)), "").alias("r"))
            path = F.when(_active(level, arity), F.concat(F.array(step), node["path"])).otherwise(node["path"])
            more = {"kids": kid["kids"]} if level > 1 else {"leaf": kid}
            return F.struct(path.alias("path"), (node["rank"] * arity + kid["d"]).alias("rank"),
                            *[c.alias(k) for k, c in more.items()])
        return F.transform(kids, child)
    return children


def come_down(blocks: DataFrame, above: DataFrame, payload: Sequence[str], arity: int, levels: int) -> DataFrame:
    """Block rows, and (g, block, path, more) of the way above each -> a row
    for each node: g, rank, path, the payload, and more."""
    known = [c for c in above.columns if c not in ("g", "block")]
    carried = F.struct(*[F.col(c) for c in known])
    tree = F.struct("n", "kids")
    kind = blocks.select(tree.alias("t")).schema["t"].dataType, above.select(carried.alias("a")).schema["a"].dataType
    rows = (blocks.select("g", "block", tree.alias("t"), F.lit(None).cast(kind[1]).alias("a"))
            .unionByName(above.select("g", "block", F.lit(None).cast(kind[0]).alias("t"), carried.alias("a"))))
    met = rows.groupBy("g", "block").agg(F.first("t", ignorenulls=True).alias("t"), F.first("a", ignorenulls=True).alias("a"))
    met = met.select("g", "block", "t.n", "t.kids", *[F.col(f"a.{c}").alias(c) for c in known])
    nodes = F.array(F.struct("path", F.col("block").alias("rank"), "kids"))
    for level in range(levels, 0, -1):
        nodes = F.flatten(F.transform(nodes, _unfold(level, arity)))
    rest = [c for c in known if c != "path"]
    return (met.select("g", F.explode(nodes).alias("node"), *rest)
            .select("g", "node.rank", "node.path", *[F.col(f"node.leaf.{p}").alias(p) for p in payload], *rest))


def prove(tables: list[DataFrame], above: DataFrame, payload: Sequence[str], arity: int, levels: int) -> DataFrame:
    """Through the block tables from the top down; ``above`` has a row for each group."""
    at = above.withColumn("block", F.lit(0).cast("long"))
    for i in range(len(tables) - 1, 0, -1):
        at = come_down(tables[i], at, [], arity, levels).withColumnRenamed("rank", "block")
    return come_down(tables[0], at, payload, arity, levels)


# ----------------------------------------------------------------- manifest
def tampered_text(id_col: Column, text: Column) -> Column:
    """The text without its newlines, in rows whose crc32 of the id is even."""
    even = F.crc32(id_col.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def _source_key(source: Column) -> Column:
    """Never null, null first, otherwise in order of the bytes."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
             text_col: str = "text", tampered=tampered_text, arity: int = ARITY, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, source, leaf, tampered_leaf, subroot, root and path, a row for
    each row of ``docs``.  ``tampered`` (id, text -> text) is what a check has to find."""
    cols = {c: F.col(f"`{c}`") for c in fields}
    text = cols[text_col].cast("string")
    changed = tampered(cols[id_col], text)
    other = F.when(changed.eqNullSafe(text), None).otherwise(leaf([changed if c == text_col else v for c, v in cols.items()]))
    leaves = stage(docs.select(cols[id_col].alias("doc_id"), _source_key(cols[source_col]).alias("g"),
                               leaf(list(cols.values())).alias("digest"), other.alias("other")), "leaves")
    payload = ["doc_id", "digest", "other"]
    nodes = ranked(leaves, "g", [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], "leaf-order")
    own = layers(nodes, ["doc_id", "other"], "blocks", arity, levels)
    subroots = own[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
    tops = layers(ranked(subroots, "g", [F.col("of").asc()], "source-order"), ["of"], "sources", arity, levels)
    top = tops[-1].select("g", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    per_source = prove(tops, top, ["of", "digest"], arity, levels).select(
        F.col("of").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    rows = prove(own, per_source, payload, arity, levels)
    source = F.when(F.col("g") != "null", F.substring("g", 2, 2 ** 31 - 1))
    return rows.select("doc_id", source.alias("source"), F.col("digest").alias("leaf"),
                       F.coalesce("other", "digest").alias("tampered_leaf"), "subroot", "root", "path")


def report(proofs: DataFrame) -> DataFrame:
    """The manifest's digests, with the proof as one digest and its check."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    out = proofs.withColumn("folded_root", fold(F.col("tampered_leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def verify(spark: SparkSession, leaves: DataFrame, proofs: DataFrame) -> DataFrame:
    """Leaves (doc_id, leaf) from elsewhere against the proofs of a manifest:
    doc_id and whether the leaf folds to the manifest's root."""
    own = proofs.select("doc_id", "path", "root")
    return leaves.join(own, "doc_id", "left").select(
        "doc_id", F.coalesce(fold(F.col("leaf"), F.col("path")) == F.col("root"), F.lit(False)).alias("verified"))
