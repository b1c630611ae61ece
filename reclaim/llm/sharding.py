"""Sharding by balanced label propagation.

Rows that belong together (here: equal texts) are linked by a common hub.  All
linked rows start in a shard by hash.  In each round a Spark join brings every
row the bytes of its neighbours in each shard, and the row names the shard it
would rather be in.  Moves are granted under capacity quotas, worked out from
the flows between pairs of shards: as much as goes the other way, and a share of
the room that the receiving shard has left.  Rounds end when hardly anything
moves.  Rows without links come last and fill the shards up evenly, so linked
rows never have to make way for them.

Where a row wants to go: the shards of its neighbours, most bytes first (the row
counts too, so that two linked rows agree on one shard and do not swap; ties by
a hash of the hub).  The first of these that can hold the whole group are its
core, one for most groups; a group larger than a shard has several, and its rows
spread over them by the room there.  Rows in the core stay.

Evenness: a shard's capacity is its share of all bytes.  What a shard holds
beyond that is released.  Loose rows (released or without links) above
1/``FINE`` of a shard go one by one, largest first, to the emptiest shard; there
are at most ``FINE`` x shards of them, whatever the table.  The others are dealt
by hash into ``BINS`` bins, and the bins, in order, fill each shard to one level.

A row costs the joins its number, size and hub, never its text.  Hub vectors have
one entry for each shard; a hub with a third of all rows is summed before the
shuffle and its join is split by AQE.  To the driver come sums by pair of shards
and bin, sums by bin, and the few largest loose rows.

Edge cases: a null text has no bytes and is equal to an empty one; sizes are
never 0, so null and empty texts count as rows; null and repeated ids are rows like others;
rows that tie in every value are told apart by their place in the input, on
which the shard of a row may depend; one text in all rows is spread over all
shards; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclaim.llm.common import stage, text_of
from reclaim.llm.ranks import ranked

SHARDS, OVERHEAD = 40, 16
ROUNDS, FLOW_BINS = 12, 64
FINE, BINS = 256, 65536
#: Rounds end when less than this share of the linked bytes has moved.
STILL = 0.001


def _bin(key: Column, use: str, bins: int) -> Column:
    """A bin by the hash of a row or hub, independent of the bins for other uses."""
    return F.pmod(F.xxhash64(key, F.lit(use)), F.lit(bins)).cast("int")


def _numbers(values: Sequence) -> Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def _at(values: Sequence, index: Column) -> Column:
    return F.element_at(_numbers(values), index + 1)


def _sums(rows: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for r in rows.groupBy("shard").agg(F.sum("size").alias("size")).collect():
        out[r["shard"]] = r["size"]
    return out


# -------------------------------------------------------------- propagation
def wishes(labels: DataFrame, links: DataFrame, room: np.ndarray) -> DataFrame:
    """labels (row, size, shard) and links (row, hub) -> labels with ``to``, the
    shard each row would rather be in (its own, if there is no better)."""
    n = len(room)
    by_hub = (links.join(labels, "row").groupBy("hub", "shard").agg(F.sum("size").alias("bytes"))
              .groupBy("hub").agg(F.collect_list(F.struct("shard", "bytes")).alias("pull")))
    met = links.join(by_hub, "hub").groupBy("row").agg(
        F.flatten(F.collect_list("pull")).alias("pull"), F.min(F.xxhash64("hub")).alias("mark"), F.count(F.lit(1)).alias("hubs"))
    met = labels.join(met, "row")
    # a row of several hubs is in each of their sums, and counts once
    own = lambda s: F.when(s == F.col("shard"), (F.col("hubs") - 1) * F.col("size")).otherwise(F.lit(0))
    total = lambda s: F.aggregate(
        F.filter("pull", lambda p: p["shard"] == s), F.lit(0).cast("long"), lambda a, p: a + p["bytes"]) - own(s)
    there = F.transform(F.array_distinct(F.transform("pull", lambda p: p["shard"])), lambda s: F.struct(
        (-total(s)).alias("less"), F.xxhash64("mark", s).alias("tie"), s.alias("shard")))
    met = met.withColumn("there", F.array_sort(there)).withColumn(
        "all", F.aggregate("there", F.lit(0).cast("long"), lambda a, e: a - e["less"]))
    # the core: from the first shard on, until bytes there and room hold the whole group
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("core"))
    core = F.aggregate("there", start, lambda a, e: F.when(a["held"] >= F.col("all"), a).otherwise(F.struct(
        (a["held"] - e["less"] + _at(room, e["shard"])).alias("held"), F.concat(a["core"], F.array(e["shard"])).alias("core"))),
        lambda a: a["core"])
    met = met.select("row", "size", "shard", core.alias("core"))
    rooms = F.aggregate("core", F.lit(0).cast("long"), lambda a, s: a + _at(room, s))
    # a place among the room of the core, by hash
    place = F.floor((_bin(F.col("row"), "place", 1 << 20) + F.lit(0.5)) / float(1 << 20) * rooms)
    walk = F.aggregate("core", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("pick")), lambda a, s: F.struct(
        (a["upto"] + _at(room, s)).alias("upto"),
        F.coalesce(a["pick"], F.when(a["upto"] + _at(room, s) > F.col("place"), s)).alias("pick")), lambda a: a["pick"])
    out = met.withColumn("place", place)
    stays = F.array_contains("core", F.col("shard"))
    return out.select("row", "size", "shard", F.when(stays, F.col("shard")).otherwise(F.coalesce(walk, "shard")).alias("to"))


def quotas(want: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bytes that may go from shard i to shard j."""
    swap = np.minimum(want, want.T)
    rest = want - swap
    share = np.minimum(1.0, room / np.maximum(rest.sum(axis=0), 1))
    return swap + np.floor(rest * share[None, :]).astype(np.int64)


def propagate(labels: DataFrame, links: DataFrame, target: float, n: int, rounds: int = ROUNDS) -> DataFrame:
    """labels (row, size, shard) after moves towards linked rows' shards."""
    sizes = _sums(labels, n)
    waiting = np.full(n, np.iinfo(np.int64).max // (4 * n))  # before the first round, any shard may still empty
    for _ in range(rounds):
        headroom = np.maximum(np.floor(target) - sizes, 0).astype(np.int64)
        room = np.minimum(headroom + waiting, int(target) + 1)
        asked = stage(wishes(labels, links, room).withColumn("bin", _bin(F.col("row"), "flow", FLOW_BINS)), "wishes")
        flows = np.zeros((n, n, FLOW_BINS), np.int64)
        for r in asked.filter("shard <> to").groupBy("shard", "to", "bin").agg(F.sum("size").alias("bytes")).collect():
            flows[r["shard"], r["to"], r["bin"]] = r["bytes"]
        want = flows.sum(axis=2)
        # whole bins, from the first on, as far as the quota goes
        upto = (np.cumsum(flows, axis=2) <= quotas(want, headroom)[:, :, None]).sum(axis=2)
        moved = np.where(np.arange(FLOW_BINS) < upto[:, :, None], flows, 0).sum(axis=2)
        if not moved.any():
            break
        goes = (F.col("shard") != F.col("to")) & (F.col("bin") < _at(upto.reshape(-1), F.col("shard") * n + F.col("to")))
        labels = asked.select("row", "size", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        waiting = (want - moved).sum(axis=1)
        sizes = sizes + moved.sum(axis=0) - moved.sum(axis=1)
        if moved.sum() < STILL * sizes.sum():
            break
    return labels


# ------------------------------------------------------------------ filling
def release(labels: DataFrame, links: DataFrame, target: float, n: int) -> DataFrame:
    """labels without the rows that their shard holds beyond ``target``: whole
    hubs by bins of their hash, the smallest bins first."""
    sizes = _sums(labels, n)
    over = np.flatnonzero(sizes > target)
    if not len(over):
        return labels
    hub = links.groupBy("row").agg(F.min(F.xxhash64("hub")).alias("mark"))
    binned = stage(labels.join(hub, "row").withColumn("bin", _bin(F.col("mark"), "release", FLOW_BINS)), "binned")
    held = {}
    for r in binned.filter(F.col("shard").isin([int(s) for s in over])).groupBy("shard", "bin").agg(F.sum("size").alias("size")).collect():
        held.setdefault(r["shard"], []).append((r["size"], r["bin"]))
    gone, edge = np.zeros(n * FLOW_BINS, np.int64), np.zeros(n * FLOW_BINS, np.int64)
    for s, bins in held.items():
        excess = sizes[s] - target
        for size, b in sorted(bins):
            if excess <= 0:
                break
            # the last bin goes in part, by the hash of its rows
            gone[s * FLOW_BINS + b], edge[s * FLOW_BINS + b] = 1, min(1.0, excess / size) * (1 << 20)
            excess -= size
    at = F.col("shard") * FLOW_BINS + F.col("bin")
    goes = (_at(gone, at) == 1) & (_bin(F.col("row"), "edge", 1 << 20) < _at(edge, at))
    return binned.filter(~goes).select("row", "size", "shard")


def water_level(sizes: np.ndarray, amount: float) -> np.ndarray:
    """How much each shard takes so that all that take any end at one level."""
    order = np.sort(sizes.astype(float))
    for k in range(len(order), 0, -1):
        level = (amount + order[:k].sum()) / k
        if level >= order[k - 1]:
            break
    return np.maximum(level - sizes, 0)


def fill(loose: DataFrame, sizes: np.ndarray, target: float) -> DataFrame:
    """loose (row, size) -> (row, shard), filling ``sizes`` to one level."""
    n = len(sizes)
    sizes = sizes.astype(np.int64).copy()
    large = F.col("size") > target / FINE
    heap = [(int(s), j) for j, s in enumerate(sizes)]
    heapq.heapify(heap)
    placed = []
    # at most FINE rows a shard are this large
    for r in loose.filter(large).select("row", "size").orderBy(F.desc("size"), "row").collect():
        size, j = heapq.heappop(heap)
        placed.append((r["row"], j))
        heapq.heappush(heap, (size + r["size"], j))
        sizes[j] += r["size"]
    small = loose.filter(~large).withColumn("bin", _bin(F.col("row"), "fill", BINS))
    bins = np.zeros(BINS, np.int64)
    for r in small.groupBy("bin").agg(F.sum("size").alias("size")).collect():
        bins[r["bin"]] = r["size"]
    upto = np.cumsum(bins)
    ends = np.cumsum(water_level(sizes, float(bins.sum())))
    # a bin goes to the shard in which its middle lies
    first = np.searchsorted(upto - bins / 2, ends[:-1], side="left")
    shard = F.size(F.filter(_numbers(first), lambda e: e <= F.col("bin").cast("long"))) if n > 1 else F.lit(0)
    out = small.select("row", shard.cast("int").alias("shard"))
    if placed:
        out = out.union(loose.sparkSession.createDataFrame(placed, "row bigint, shard int"))
    return out


# ----------------------------------------------------------------- sharding
def equal_texts(rows: DataFrame) -> DataFrame:
    """(row, h) -> links (row, hub) of the rows whose ``h`` another row has too."""
    hubs = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return rows.join(hubs, "h").select("row", F.col("h").alias("hub"))


def assign(rows: DataFrame, links: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows (row bigint, size bigint, both not null) and links (row, hub) ->
    (row, shard), a shard for each row.  Both should be staged tables."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = total / n_shards
    start = rows.join(links.select("row"), "row", "left_semi").withColumn("shard", _bin(F.col("row"), "start", n_shards))
    labels = propagate(stage(start.select("row", "size", "shard"), "labels"), links, target, n_shards, rounds)
    labels = stage(release(labels, links, target, n_shards), "labels")
    loose = stage(rows.join(labels.select("row"), "row", "left_anti").select("row", "size"), "loose")
    return labels.select("row", "shard").union(fill(loose, _sums(labels, n_shards), target))


def shard(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD,
          links=equal_texts, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the place in the shard), a row for
    each row of ``docs``.  ``links`` makes (row, hub) from (row, doc_id, size, h),
    ``h`` being a hash of the text."""
    text = text_of(text_col)
    rows = stage(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"))
        .withColumn("row", F.monotonically_increasing_id()), "rows")
    linked = stage(links(rows), "links")
    placed = rows.drop("h").join(assign(rows.select("row", "size"), linked, n_shards, rounds), "row").drop("row")
    placed = stage(placed, "shards")
    return ranked(placed, "shard", [F.col("doc_id").asc_nulls_last()], "slots").drop("n").withColumnRenamed("rank", "slot")


def cut_edges(sharded: DataFrame, hub: str) -> DataFrame:
    """For each hub with several rows: its rows, and the shards they are in."""
    return (sharded.groupBy(hub).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("shard").alias("n_shards"))
            .filter("n_rows > 1"))
