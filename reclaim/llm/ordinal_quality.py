"""Quality by ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < G-1 share one weight vector over hashed text features; the
thresholds between grades are ordered: P(grade >= g) = sigmoid(w x - t_g), with
t_1 < t_2 < ...  A document gets its expected grade, sum of P(grade >= g), and
the tail probability P(grade >= select), by which documents are selected.

Features, hashed into ``BUCKETS``: words, shapes of words (runs of capitals,
small letters, digits as one sign each, other signs as they are), pairs of
adjacent shapes, repeats of the word before, and the share of distinct words.
Each counts with the square root of its share of the text's features, so
length does not matter.  Whole texts are read, a stretch at a time.

The weights are fitted on a bounded sample: the ``SAMPLE`` rated ids with the
smallest hash, none of those whose crc32 mod 4 is 2, in ``EPOCHS`` passes of
adaptive gradient steps in a fixed order.  Of each it takes the ``FEATURES``
heaviest features of the whole text, so what comes to the driver is bounded
whatever the length of the texts.

Edge cases: a null text counts as empty and is graded by the thresholds alone;
without ratings, or with one grade only, that grade (0 without any) is
expected of all; rows that repeat a doc_id are graded each; of ratings that
contradict each other the lower counts; null ratings are left out; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclaim.llm.common import held_out, stage, text_of

BUCKETS, SAMPLE, EPOCHS, BATCH, RATE, RIDGE = 1 << 18, 12_000, 12, 128, 0.15, 1e-6
MEMO = 300_000
#: Of a rated text, the weights are fitted on so many of its features, the heaviest; texts are graded by all of theirs.
FEATURES = 4096
_CUT = re.compile(r"\s")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _sign(run: re.Match) -> str:
    letters = run[0]
    return "A" if len(letters) > 1 and letters.isupper() else "Aa" if letters[0].isupper() else "a"


def shape(word: str) -> str:
    return _DIGITS.sub("0", _LETTERS.sub(_sign, word))[:12]


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


class Words(dict):
    """word -> (bucket of the word, bucket of its shape), for up to MEMO words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= MEMO:
            self.clear()
        v = self[word] = (_bucket("w" + word.lower()), _bucket("s" + shape(word)))
        return v


def features(text: str | None, memo: Words) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of one text."""
    text, a, last, n, parts = text or "", 0, None, 0, []
    distinct: set[int] = set()
    while a < len(text):
        cut = _CUT.search(text, a + (1 << 20))
        z = cut.start() if cut else len(text)
        words = text[a:z].split()
        a = z
        if not words:
            continue
        both = np.array([memo[w] for w in words], np.int64)
        before = np.vstack([both[:1] if last is None else last, both])
        pair = (before[:-1, 1] * 31 + before[1:, 1] * 17 + 7) % BUCKETS
        again = np.where(before[:-1, 0] == before[1:, 0], _bucket("repeat"), _bucket("fresh"))
        parts.append(np.unique(np.concatenate([both[:, 0], both[:, 1], pair, again]), return_counts=True))
        last, n = both[-1:], n + len(words)
        distinct.update(both[:, 0].tolist())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    parts.append((np.array([_bucket(f"distinct {10 * len(distinct) // n}, {int(np.log2(n))}")]), np.array([n])))
    some, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(at, np.concatenate([p[1] for p in parts]))
    return some, np.sqrt(total / total.sum())


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """P(grade >= g) for g = 1 .. G-1."""
        return _sigmoid(self.weights[x[0]] @ x[1] - self.thresholds)


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int) -> Model:
    """Cumulative-link likelihood by AdaGrad; thresholds stay ordered as a first
    one and logarithms of the steps between."""
    share = [np.clip((grades >= g).mean(), 1e-3, 1 - 1e-3) for g in range(1, n_grades)]
    start = -np.log(np.array(share) / (1 - np.array(share)))
    t0, steps = start[0], np.log(np.maximum(np.diff(start), 0.05))
    w, seen, t_seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), np.full(n_grades - 1, 1e-8)
    order = np.arange(len(rows))
    for epoch in range(EPOCHS):
        np.random.default_rng(epoch).shuffle(order)
        for a in range(0, len(order), BATCH):
            some = order[a:a + BATCH]
            at = np.concatenate([rows[i][0] for i in some])
            value = np.concatenate([rows[i][1] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            eta = np.bincount(doc, w[at] * value, len(some))
            cut = np.concatenate([[-np.inf], t0 + np.concatenate([[0], np.cumsum(np.exp(steps))]), [np.inf]])
            y = grades[some]
            up, down = _sigmoid(eta - cut[y]), _sigmoid(eta - cut[y + 1])  # P(>= y), P(>= y + 1)
            p = np.maximum(up - down, 1e-9)
            d_up, d_down = up * (1 - up), down * (1 - down)
            d_eta = -(d_up - d_down) / p / len(some)
            d_cut = np.zeros(n_grades + 1)
            np.add.at(d_cut, y, d_up / p / len(some))
            np.add.at(d_cut, y + 1, -d_down / p / len(some))
            d_cut = d_cut[1:-1]
            grad = np.bincount(at, d_eta[doc] * value, BUCKETS)
            touched = np.unique(at)
            g = grad[touched] + RIDGE * w[touched]
            seen[touched] += g * g
            w[touched] -= RATE * g / np.sqrt(seen[touched])
            tail = np.cumsum(d_cut[::-1])[::-1]  # a step moves every threshold above it
            t_grad = np.concatenate([[tail[0]], tail[1:] * np.exp(steps)])
            t_seen += t_grad * t_grad
            move = RATE * t_grad / np.sqrt(t_seen)
            t0, steps = t0 - move[0], steps - move[1:]
    return Model(w, t0 + np.concatenate([[0], np.cumsum(np.exp(steps))]))


def heaviest(x: tuple[np.ndarray, np.ndarray], most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` features of greatest weight, of equal ones those of the smallest bucket."""
    at, value = x
    if len(at) <= most:
        return x
    some = np.sort(np.lexsort((at, -value))[:most])
    return at[some], value[some]


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        grade_col: str = "grade", sample: int = SAMPLE) -> Model:
    ids = ratings.select(F.col(f"`{id_col}`").alias("r_id"), F.col(f"`{grade_col}`").cast("int").alias("grade")).dropna()
    ids = ids.filter(~held_out("r_id")).groupBy("r_id").agg(F.min("grade").alias("grade"))
    mark = F.xxhash64(F.col("r_id").cast("string"), F.lit("quality"))
    drawn = ids.orderBy(mark, "r_id").limit(sample)
    drawn = docs.sparkSession.createDataFrame(drawn.collect(), drawn.schema)  # at most `sample` rows of 16 bytes
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("text")).join(
        F.broadcast(drawn), F.col("_id") == F.col("r_id")).select(F.col("_id").cast("string").alias("id"), "text", "grade")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Words()
        for pdf in batches:
            both = [heaviest(features(t, memo)) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "grade": pdf["grade"], "at": [a.astype("<i4").tobytes() for a, _ in both],
                                "value": [v.astype("<f4").tobytes() for _, v in both]})

    # written once, and read a part at a time: the driver holds the features alone, not also their way to it
    got = stage(rows.mapInPandas(extract, "id string, grade int, at binary, value binary"), "features", text=True)
    given = sorted(((r["id"] or "", r["grade"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["value"], "<f4"))
                    for r in got.filter(F.length("at") > 0).toLocalIterator()), key=lambda r: r[:2])
    grades = np.array([r[1] for r in given], np.int64)
    if not len(grades) or grades.min() == grades.max():
        top = int(grades.max()) if len(grades) else 0
        return Model(np.zeros(BUCKETS), np.repeat([-35.0, 35.0], [top, 1]))
    return fit_ordinal([r[2:] for r in given], grades, int(grades.max()) + 1)


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", select: int = 1,
          least: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, expected_grade, tail
    (P(grade >= select)), tails (of every grade from 1) and selected."""
    kind = docs.schema[id_col].dataType.simpleString()
    # plain arrays, as a broadcast is not pickled by value; BUCKETS doubles
    carried = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, memo = Model(*carried.value), Words()
        for pdf in batches:
            tails = [model.tails(features(t, memo)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "expected_grade": [t.sum() for t in tails],
                                "tail": [t[min(select, len(t)) - 1] for t in tails], "tails": tails})

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    out = rows.mapInPandas(rate, f"doc_id {kind}, expected_grade double, tail double, tails array<double>")
    return out.withColumn("selected", F.col("tail") >= least)
