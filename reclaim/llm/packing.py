"""Best-fit packing by large-item matching.

Documents are encoded, ended by one id, and those longer than a sequence are
cut into full pieces with the remainder in front.  Pieces above a third of the
capacity fit at most two to a sequence, so they are matched greedily: from the
largest down, each with the largest that still fits beside it.  Smaller pieces
then go, from the largest down, into the sequence whose gap they fill best.

Lengths are whole numbers up to the capacity, so the matching and the best fit
are worked out on the number of pieces of each length: equal pieces are
interchangeable, and a step says "items lo..hi of length L go into sequences
from s on, so many to each".  The driver sees at most ``capacity`` counts,
whatever the input, and the number of steps is bounded by the capacity alone
(sequences are kept as runs with the same gap; a length splits one run at
most).  Pieces get their number within a length from counts by salted bucket,
so a length that a third of all pieces share is spread over many tasks.

Token ids come from tiktoken, on the same vocabulary and pattern as the
tokenizers file: the ids are the same (the tests compare them), several times
faster.

Edge cases: a null text counts as empty and gives one piece with the end id
alone; very long texts are encoded in stretches cut where a word starts, which
leaves the ids as they are; rows that repeat a doc_id are packed each; a null
doc_id stays null; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import base64
import re
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reclaim.llm.common import stage, text_of, worker_cache

CAPACITY, END_ID = 1024, 2
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces of one length numbered in one group.
BUCKET = 100_000
_GAP = re.compile(r"(?<=\S) (?=\S)")


def ranks_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """text -> ids, by the ranks file at ``path``.  Where its pattern gives up (a
    run of millions of blanks), the tokenizers file takes over."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.slow = None
        self.slow_path = public_tokenizers.path("byte_bpe_50k.json")

    def ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:
            from tokenizers import Tokenizer
            self.slow = self.slow or Tokenizer.from_file(self.slow_path)
            return self.slow.encode(text, add_special_tokens=False).ids


def encoder(path: str) -> Encoder:
    """Made once by each worker process."""
    return worker_cache(("tiktoken", path).__repr__(), lambda: Encoder(path))


def stretches(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in stretches cut at single spaces between words, where the
    tokenizer's pattern starts a new word whatever stands around."""
    a = 0
    while len(text) - a > size:
        m = _GAP.search(text, a + size)
        if not m:
            break
        yield text[a:m.start()]
        a = m.start()
    yield text[a:]


def encode(enc: Encoder, text: str, end_id: int = END_ID) -> np.ndarray:
    parts = [np.array(enc.ids(s), "<u4") for s in stretches(text)]
    return np.concatenate([*parts, np.array([end_id], "<u4")])


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, path: str,
           keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), a row each piece; staged
    with a number ``row``."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encode(enc, text, end_id)
                n, a = len(ids), 0
                for p in range(-(-n // capacity)):
                    b = a + ((n - 1) % capacity + 1 if p == 0 else capacity)
                    out.append((doc, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) + ((ids[a:b].astype("int32"),) if keep_ids else ()))
                    a = b
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = pd.Series([r[0] for r in out], dtype=pdf["doc_id"].dtype)
            yield frame

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    return stage(rows.mapInPandas(cut, schema).withColumn("row", F.monotonically_increasing_id()), "pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, lo, hi, sequence, per, offset): item r of this length,
    lo <= r < hi, goes to sequence + (r - lo) // per, at offset + (r - lo) % per
    * length."""
    left = {n: c for n, c in counts.items() if c}
    used: dict[int, int] = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    steps, opened = [], 0

    def put(length: int, items: int, sequence: int, per: int, offset: int) -> None:
        steps.append((length, used[length], used[length] + items, sequence, per, offset))
        used[length] += items
        left[length] -= items

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((sequence, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        for other in large:
            if other > length or length + other > capacity or not left[length]:
                continue
            n = left[length] // 2 if other == length else min(left[length], left[other])
            if n:
                put(length, n, opened, 1, 0)
                put(other, n, opened, 1, length)
                leave(capacity - length - other, opened, n)
                opened += n
        if n := left[length]:
            put(length, n, opened, 1, 0)
            leave(capacity - length, opened, n)
            opened += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while n := left[length]:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                gap, many = capacity, -(-n // (capacity // length))
                gaps[gap] = [(opened, many)]
                opened += many
            sequence, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            per = gap // length
            if full := min(many, n // per):
                put(length, full * per, sequence, per, capacity - gap)
                leave(gap - per * length, sequence, full)
                leave(gap, sequence + full, many - full)
            else:
                put(length, n, sequence, n, capacity - gap)
                leave(gap - n * length, sequence, 1)
                leave(gap, sequence + 1, many - 1)
    return steps


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids)."""
    cut = pieces(docs, id_col, text_col, capacity, end_id, path or ranks_path(), keep_ids)
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    steps = sorted(plan(counts, capacity))
    buckets = -(-max(counts.values(), default=1) // BUCKET)
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    by = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    rows = rows.withColumn("nth", nth).join(by, ["length", "bucket"]).withColumn("item", F.col("first") + F.col("nth") - 1)
    table = np.array(steps, np.int64).reshape(-1, 6)

    @pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, item: pd.Series) -> pd.DataFrame:
        size, n = length.to_numpy(np.int64), item.to_numpy(np.int64)
        at = np.searchsorted((table[:, 0] << 48) + table[:, 1], (size << 48) + n, side="right") - 1
        _, lo, _, sequence, per, offset = table[at].T
        return pd.DataFrame({"sequence_id": sequence + (n - lo) // per, "offset": offset + (n - lo) % per * size})

    out = rows.withColumn("place", place("length", "item"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset",
                      *["ids"] * keep_ids)
