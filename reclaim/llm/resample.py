"""Target-distribution importance resampling with prefix-CRC substrings.

A document's features are its runs of one to three words; each falls into a
bucket by its CRC32.  Buckets that are more frequent in the target (the
benchmark texts) than in the corpus have a gain above zero, a document's weight
is the sum of the gains of its features, and documents are drawn without
replacement by weight plus Gumbel noise from a hash of their id.

No feature is ever written out as a text.  Each document is scanned once, with
its words joined by one separator, and the running CRC at the end of each word
is stored.  The CRC of the words i to j follows from two of these: the one at
the end of j, and the one before i shifted by the length of the run, which is a
multiplication in GF(2) that cancels all that came before i.  Shifts by powers
of two are table lookups, so a whole document is done in a few array steps.

The running CRCs (4 bytes a word, and its length) are a staged table, read for
the counts and for the weights; texts are not read again.  To the driver come
one number a bucket.  Features are worked out ``SLICE`` words at a time, so a
very long text costs no more memory than its text and 8 bytes a word.  The draw
is a place in a global order (``ranks``), taken from a table of ids and scores;
nothing is gathered in one task.

Edge cases: a null or empty text has no words, no features and weight 0;
documents under ``min_words`` words are never drawn; ties in score go to the
smaller doc_id, a null id last; a null id draws by the hash of ``42:null``;
rows that repeat an id and text have the same score and each its own rank;
an empty target has counts 0, as has an empty table; other columns are not
read.
"""

from __future__ import annotations

import math
import zlib
from itertools import accumulate
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclaim.llm.common import stage, text_chunks, text_of
from reclaim.llm.ranks import ranked

MAX_WORDS, BUCKETS, MIN_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, "42"
SLICE = 1 << 18

POLYNOMIAL = 0xEDB88320  # of CRC32, lowest power in the highest bit


# ------------------------------------------------------------ words and CRCs
def _letters() -> bytes:
    """Byte to byte: A-Z to lower case, letters, digits and all bytes of
    characters beyond ASCII as they are, everything else to a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def running(data: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the CRC of all words up to it, a space before each; and its length."""
    crc, crcs, lengths = 0, [], []
    for chunk in text_chunks(data):
        words = chunk.translate(table).split()
        if words:
            got = np.fromiter(accumulate(words, lambda c, w: zlib.crc32(w, zlib.crc32(b" ", c)), initial=crc), np.uint32, len(words) + 1)
            crc = int(got[-1])
            crcs.append(got[1:])
            lengths.append(np.fromiter(map(len, words), np.uint32, len(words)))
    if not crcs:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    return np.concatenate(crcs), np.concatenate(lengths)


class Shifts:
    """CRC arithmetic on arrays: what a CRC becomes when bytes follow."""

    def __init__(self):
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = (one >> np.uint32(1)) ^ (one & np.uint32(1)) * np.uint32(POLYNOMIAL)
        self.one = one  # the remainder of each byte value
        # multiplication by x^(8 * 2^b), as a table for each byte of the register
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        images = self._zero_byte(bits)
        self.tables = []
        for _ in range(32):
            table = self._table(images)
            self.tables.append(table)
            images = self._apply(table, images)

    def _zero_byte(self, crc: np.ndarray) -> np.ndarray:
        return self.one[crc & np.uint32(255)] ^ (crc >> np.uint32(8))

    @staticmethod
    def _table(images: np.ndarray) -> np.ndarray:
        table = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                table[byte, 1 << bit:2 << bit] = table[byte, :1 << bit] ^ images[8 * byte + bit]
        return table

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        low, high = crc.view(np.uint8).reshape(-1, 4)[:, :2], crc.view(np.uint8).reshape(-1, 4)[:, 2:]
        return table[0][low[:, 0]] ^ table[1][low[:, 1]] ^ table[2][high[:, 0]] ^ table[3][high[:, 1]]

    def then_space(self, crc: np.ndarray) -> np.ndarray:
        """The CRC of the same bytes and a space after them."""
        return ~(self._zero_byte(~crc ^ np.uint32(32)))

    def shifted(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What ``crc`` adds to a CRC that goes on for ``length`` bytes."""
        out = crc.copy()
        for b in range(int(length.max(initial=0)).bit_length()):
            on = np.flatnonzero(length >> np.uint32(b) & np.uint32(1))
            out[on] = self._apply(self.tables[b], out[on])
        return out

    def features(self, crcs: np.ndarray, lengths: np.ndarray, max_words: int = MAX_WORDS, size: int = SLICE) -> Iterator[np.ndarray]:
        """The CRCs of all runs of 1 to ``max_words`` words, in pieces."""
        for a in range(0, len(crcs), size):
            n = min(size, len(crcs) - a)  # runs that start in this slice
            before = np.zeros(n, np.uint32)
            before[(a == 0):] = crcs[max(a - 1, 0):a + n - 1]
            before = self.then_space(before)
            long = np.zeros(n, np.uint32)
            for w in range(min(max_words, len(crcs) - a)):
                m = min(n, len(crcs) - a - w)  # runs of w + 1 words
                long = long[:m] + lengths[a + w:a + w + m] + np.uint32(w > 0)
                yield crcs[a + w:a + w + m] ^ self.shifted(before[:m], long)


# --------------------------------------------------------------- Spark steps
def prefix_crcs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "prefixes") -> DataFrame:
    """(doc_id, n_words, crcs, lengths), arrays as little-endian unsigned 32-bit bytes; staged."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _letters()
        for pdf in batches:
            found = [running(t, table) for t in pdf["text"]]
            yield pd.DataFrame({"row": pdf["row"], "n_words": [len(c) for c, _ in found],
                                "crcs": [c.tobytes() for c, _ in found], "lengths": [n.tobytes() for _, n in found]})

    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("doc_id")).alias("row"), text_of(text_col).cast("binary").alias("text"))
    out = rows.mapInPandas(scan, f"row struct<doc_id:{ids}>, n_words bigint, crcs binary, lengths binary")
    return stage(out.select("row.doc_id", "n_words", "crcs", "lengths"), label, text=True)


def bucket_counts(prefixes: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> np.ndarray:
    """How many features of the whole table fall into each bucket."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shifts, total = Shifts(), np.zeros(buckets, np.int64)
        for pdf in batches:
            for c, n in zip(pdf["crcs"], pdf["lengths"]):
                for f in shifts.features(np.frombuffer(c, np.uint32), np.frombuffer(n, np.uint32), max_words):
                    total += np.bincount(f % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    found = prefixes.select("crcs", "lengths").mapInPandas(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 ln (target share / corpus share)), one added to each count."""
    own, other, k = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (own + k) / ((s + 1.0) * (other + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(prefixes: DataFrame, gain: np.ndarray, max_words: int = MAX_WORDS, label: str = "weights") -> DataFrame:
    """(doc_id, n_words, n_features, weight), staged."""
    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shifts, k = Shifts(), np.uint32(len(gain))
        for pdf in batches:
            rows = []
            for c, n in zip(pdf["crcs"], pdf["lengths"]):
                n_features = weight = 0
                for f in shifts.features(np.frombuffer(c, np.uint32), np.frombuffer(n, np.uint32), max_words):
                    n_features += len(f)
                    weight += int(gain[f % k].sum())
                rows.append((n_features, weight))
            yield pd.DataFrame({"row": pdf["row"], "n_words": pdf["n_words"],
                                "n_features": [a for a, _ in rows], "weight": [b for _, b in rows]})

    ids = prefixes.schema["doc_id"].dataType.simpleString()
    rows = prefixes.select(F.struct("doc_id").alias("row"), "n_words", "crcs", "lengths")
    out = rows.mapInPandas(add_up, f"row struct<doc_id:{ids}>, n_words bigint, n_features bigint, weight bigint")
    return stage(out.select("row.doc_id", "n_words", "n_features", "weight"), label)


def noise(id_col: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(weights: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """weights with score and rank: 1, 2, 3... for the drawn, null for the others."""
    rows = weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    enough = F.col("n_words") >= min_words
    n = rows.filter(enough).count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = ranked(rows.filter(enough).withColumn("_all", F.lit(0)), "_all", order, "draw").drop("_all", "n")
    drawn = placed.withColumn("rank", F.when(F.col("rank") < percent * n // 100, F.col("rank") + 1))
    return drawn.unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id",
             target_text: str = "text", buckets: int = BUCKETS, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank, a row for each row of ``docs``."""
    own = prefix_crcs(docs, id_col, text_col)
    other = prefix_crcs(target, target_id, target_text, "target-prefixes")
    gain = gains(bucket_counts(own, buckets, max_words), bucket_counts(other, buckets, max_words))
    return draw(weigh(own, gain, max_words), min_words, percent, seed)
