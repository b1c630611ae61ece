"""Small tables and brute-force versions shared by the tests of the package."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import xxhash

SF = "/root/testdata/sf0.001"
#: Column names that the operators use inside; a table may have them too.
CLASH = ["row", "name", "level", "size", "k", "g", "q", "p", "u", "bin", "fp", "component", "kept", "keep_id", "score",
         "lang_pred", "rejected", "spans", "windows", "unit", "keys", "node", "copies", "_id", "_t", "_row", "label",
         "half", "bucket", "item", "length", "n_copies", "words", "target"]

EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, "one", "en", "a"),
    (5, "one  two\nthree four five", "en", "b"), (6, "one two three four five", "en", "b"),
    (7, "one two three four five", "en", "b"), (7, "one two three four five", "en", "b"),
    (8, "word " * 30000, "en", None), (None, "no id at all here", "de", "c"), (None, "no id at all here", "de", "c"),
    (9, "x" * 200000, "en", "a"), (10, "12345 6789 !!", "en", "a"), (11, "one two three four five six", "fr", "a"),
    (12, "password = hunter22 <|endoftext|> 日本語 \U0001f600", "ja", "a"),
]


def documents(spark, rows=EDGE, clash=True):
    """The documents schema, with clashing columns after it."""
    names = ["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint"]
    more = [f"`{c}` string" for c in CLASH] if clash else []
    data = [(*r, len(r[1] or ""), *(["x"] * len(more))) for r in rows]
    return spark.createDataFrame(data, ", ".join(names + more))


def invented(n: int, seed: int = 1, words: int = 60) -> list[tuple]:
    """n documents of invented prose, some of them copies and near copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            text = rng.choice(out)[1].replace(" ", "  ", 1)
        elif out and kind < 0.35:
            t = rng.choice(out)[1].split(" ")
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
            text = " ".join(t)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.randint(1, words * 6)))
        out.append((i, text, "en", f"s{i % 5}"))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text, k=4, seed=42):
    w = [x.encode() for x in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), seed) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(n, pairs):
    """Smallest index reachable, by union-find."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 4 == 2
