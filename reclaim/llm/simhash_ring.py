"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits link when at most ``max_bits`` bits differ.  The 64 bits
are cut into m = 4 * max_bits segments in a ring.  If two fingerprints differ
in at most max_bits bits, the pigeonring principle gives a start in the ring
from which, for every length l, the first l segments together differ in at
most l * max_bits / m bits, that is floor(l / 4) here.  So from some start
three segments agree, and the four after them differ in one bit at most: cut
into parts, all of these but one agree too.  Each (start, part left out) is a key
on which candidates meet by an equi-join; then the chain is required at every
length, and what passes gets the full Hamming check.  Nothing is lost: the
filter is exact, whatever the number of parts.

Two parts give 32 keys of about 20 bits, four 64 of 24, eight 128 of 26.  ``parts_for``
takes the fewest that leave about ``MEMBERS`` unrelated fingerprints to a key, so
comparisons grow more slowly than the square of the table.

Equal fingerprints are one node from the start, so copies cost nothing.  Hot
keys are compared in blocks (``in_blocks``).  A task gives back the edges of a
spanning forest of the links it found, never all pairs of a group.

Edge cases: a null text counts as empty; texts without words have fingerprint
zero, which links like any other; rows that repeat a doc_id each come out; a
null doc_id never names a component unless the component has no other id; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reclaim.llm.common import (Forest, components, in_blocks, keep_rows, pairs_within, stage, text_chunks,
                                text_key, text_of, whole_units)

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Members of a key compared in one piece.
BLOCK = 2048
#: Unrelated fingerprints to a key, above which there are more and longer keys.
MEMBERS = 512
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, k: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every k-word shingle of the text, in arrays of bounded size."""
    digest, carry, any_word, full = xxhash.xxh64_intdigest, [], False, False
    for chunk in text_chunks(text.encode("utf-8", "surrogatepass").translate(_LOWER)):
        words = carry + chunk.split()
        any_word |= bool(words)
        n = len(words) - k + 1
        if n > 0:
            line = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            start = end - size
            yield np.array([digest(line[a:b], seed) for a, b in zip(start[:n].tolist(), end[k - 1:].tolist())], np.uint64)
            full = True
        carry = words[-(k - 1):] if k > 1 else []
    if any_word and not full:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def simhash(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer; zero without words."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text or "", k, seed):
        n += len(h)
        for a in range(0, len(h), 65536):
            ones += np.unpackbits(h[a:a + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n)
    return int(bits.view(np.int64)[0]) if n else 0


class Ring:
    """Segments, keys and chain budgets for one number of bits."""

    def __init__(self, max_bits: int, parts: int = 2):
        if not 1 <= max_bits <= 16:
            raise ValueError("max_bits must be from 1 to 16")
        m = 4 * max_bits
        edge = [round(64 * i / m) for i in range(m + 1)]
        segment = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
        run = lambda i, a, b: sum(segment[(i + j) % m] for j in range(a, b))
        #: of each slot, the bits that must agree
        self.keys = [run(i, 0, 3) | run(i, 3, 7) & ~part for i in range(m) for part in self._parts(run(i, 3, 7), parts)]
        #: of each length that raises the budget: the bits of the chain by slot, the budget
        self.chains = [(np.array([run(i, 0, n) for i in range(m) for _ in range(parts)], np.uint64), n // 4)
                       for n in range(7, m, 4)]
        self.max_bits = max_bits


    @staticmethod
    def _parts(bits: int, n: int) -> list[int]:
        """The set bits, dealt in their order to n masks."""
        places = [b for b in range(64) if bits >> b & 1]
        return [sum(1 << b for b in places[len(places) * k // n:len(places) * (k + 1) // n]) for k in range(n)]


def parts_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The number of parts for n distinct fingerprints."""
    for parts in (2, 4, 8):
        if n >> min(k.bit_count() for k in Ring(max_bits, parts).keys) <= MEMBERS:
            break
    return parts


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp, staged) -> edges (u, v) whose components are those
    of all pairs that differ in at most ``max_bits`` bits."""
    ring = Ring(max_bits, parts or parts_for(prints.count(), max_bits))
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(k))).alias("key"))
                      for i, k in enumerate(ring.keys)])
    rows = prints.select("fp", F.explode(slots).alias("k")).select("fp", "k.slot", "k.key")
    unit = ["slot", "key", "bi", "bj"]
    keys, chains, limit = None, ring.chains, ring.max_bits

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, number in whole_units(batches, unit):
            fp, at = np.unique(pdf["fp"].to_numpy(), return_inverse=True)
            bits, slot = pdf["fp"].to_numpy().view(np.uint64), pdf["slot"].to_numpy()
            own, same = pdf["b"].to_numpy(), (pdf["bi"] == pdf["bj"]).to_numpy()
            forest = Forest(len(fp))
            for i, j in pairs_within(number):
                fresh = same[i] | (own[i] != own[j])
                i, j = i[fresh], j[fresh]
                diff = bits[i] ^ bits[j]
                for masks, budget in chains:
                    pass_on = np.bitwise_count(diff & masks[slot[i]]) <= budget
                    i, j, diff = i[pass_on], j[pass_on], diff[pass_on]
                close = np.bitwise_count(diff) <= limit
                forest.add(at[i[close]], at[j[close]])
            root = forest.settle()
            node = np.flatnonzero(root != np.arange(len(fp)))
            if len(node):
                yield pd.DataFrame({"u": fp[node], "v": fp[root[node]]})

    return in_blocks(rows, ["slot", "key"], "fp", block, "hotkeys").mapInPandas(compare, "u bigint, v bigint")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, seed: int, *more) -> DataFrame:
    """(doc_id, fp, more columns), staged."""
    @pandas_udf("bigint")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([simhash(x, k, seed) for x in t], dtype="int64")

    return stage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint(text_of(text_col)).alias("fp"), *more), "prints")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
               max_bits: int = MAX_BITS, seed: int = SEED, block: int = BLOCK, more=()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, component (a fingerprint
    of it), component_id (the smallest doc_id reachable by links), ``more``."""
    rows = fingerprints(docs, id_col, text_col, k, seed, *more)
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp"), max_bits, block), "stars")
    low = (nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
           .withColumn("component", F.coalesce("component", "fp")))
    least = low.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(low.join(least, "component").select("fp", "component", "component_id"), "fp")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                     max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of
    several with this id the first by text key."""
    found = near_dedup(docs, id_col, text_col, k, max_bits, seed, more=(text_key(text_col).alias("_t"),))
    kept = (found.groupBy("component")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_t")).alias("one"))
            .select(F.col("one.doc_id").alias("_id"), F.col("one._t").alias("_t")))
    return keep_rows(docs, kept, id_col, text_key(text_col))
