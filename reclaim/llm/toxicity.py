"""Toxicity by maximum-scoring segments.

A text is a row of tokens: its words, and after each word of more than ``STEM``
letters its first ``STEM`` letters, which speak for forms never seen.  Every
token has a score: the log-odds of toxic against clean text with an informative
Dirichlet prior (the corpus' own token frequencies), shrunk by its standard
error and lowered by a drift, so that ordinary text scores below zero.
A linear-time scan finds all maximal scoring segments of a text (each is the
best within itself and can't be extended to gain).  Extreme-value calibration
says what such a segment is worth: with background frequencies q, lambda solves
sum q exp(lambda s) = 1, and K is fitted on clean texts, so that
E = K n exp(-lambda S) is the number of segments of score S expected in n
tokens by chance.  Segments with E below ``SIGNIFICANT`` are the passages; the
best one, their summed evidence, their density and the length go through a
logistic curve fitted on texts that the scores were not learned from.

Token counts of the background cover all texts, whole.  Labels are learned from
a bounded sample: the ``SAMPLE`` labelled ids with the smallest hash, none of
those whose crc32 mod 4 is 2.  Its ids are broadcast (16 bytes each), and it is
halved so that each half is scored by the other's model for the curve.  Tokens
are hashed into ``BUCKETS``, which bounds the model.

Edge cases: a null or empty text, or one without letters, has no segment and
gets the curve's value for that; without labels of both kinds every
score is the share of toxic labels (0 without any); rows that repeat a doc_id
are scored each; labels that contradict each other count as toxic; an empty
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

BUCKETS, SAMPLE = 1 << 18, 20_000
STEM, PRIOR, SHRINK, DRIFT, CLIP = 5, 5000.0, 1.5, 0.5, 6.0
SIGNIFICANT = 0.5
MEMO = 500_000
_TOKEN = re.compile(r"[^\W\d_]+")
_CUT = re.compile(r"\s")


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


class Buckets(dict):
    """word -> its bucket and, in the low half, that of its stem (BUCKETS for a
    short word), remembered for up to MEMO words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        stem = _bucket("^" + word[:STEM]) if len(word) > STEM else BUCKETS
        v = self[word] = _bucket(word) << 32 | stem
        return v


def tokens(text: str | None, memo: Buckets) -> np.ndarray:
    """Buckets of the tokens of a text, a stretch at a time."""
    text, a, parts = (text or "").lower(), 0, []
    while a < len(text):
        cut = _CUT.search(text, a + (1 << 20))
        z = cut.start() if cut else len(text)
        words = _TOKEN.findall(text, a, z)
        pairs = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        row = np.column_stack([pairs >> 32, pairs & 0xFFFFFFFF]).ravel()
        parts.append(row[row < BUCKETS].astype(np.int32))
        a = z
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) in one pass.  Kept
    segments form a stack; a new one joins back to the last that starts lower,
    if that ends lower too."""
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    at = np.flatnonzero(scores > 0)
    stack: list[tuple[float, float, int, int, int]] = []
    for p, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        first = p
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]  # the next that starts lower than this one
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, p + 1, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(r - low, a, z) for low, r, a, z, _ in stack]


@dataclass
class Model:
    scores: np.ndarray
    lam: float
    k: float
    curve: np.ndarray  # mean, scale and weight of each feature; at last the offset

    def logits(self, n: int, found: list[tuple[float, int, int]]) -> float:
        x = (features(n, [self.lam * s for s, _, _ in found], self.k) - self.curve[0]) / self.curve[1]
        return float(x @ self.curve[2] + self.curve[3][0])


def features(n: int, bits: list[float], k: float) -> np.ndarray:
    """Of n tokens with segments of normalised scores ``bits``: the best
    evidence (-ln E), the summed evidence and density of significant ones, size."""
    m = max(n, 1)
    worth = [b - np.log(k * m) for b in bits]
    strong = [w for w in worth if w > -np.log(SIGNIFICANT)]
    return np.array([max(max(worth, default=-8.0), -8.0), np.log1p(sum(strong)), 100.0 * len(strong) / m, np.log(m)])


def token_scores(toxic: np.ndarray, clean: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Shrunk log-odds with an informative Dirichlet prior, less the drift."""
    prior = PRIOR * background / max(background.sum(), 1.0) + 1e-4
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    error = np.sqrt(1 / a + 1 / b)
    shrunk = np.sign(odds) * np.maximum(np.abs(odds) - SHRINK * error, 0)
    return np.clip(shrunk, -CLIP, CLIP) - DRIFT


def gumbel_lambda(scores: np.ndarray, background: np.ndarray) -> float:
    """The positive root of sum q exp(lambda s) = 1; 1 where no score is positive."""
    q, s = background[background > 0], scores[background > 0]
    if not len(q) or s.max() <= 0:
        return 1.0
    low, high, q = 1e-6, 50.0, q / q.sum()
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if q @ np.exp(mid * s) > 1 else (mid, high)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    return np.array([mean, scale, w[:-1], np.full(x.shape[1], w[-1])])


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """(l_id, label, half): at most ``sample`` ids a model may learn from."""
    ids = labels.select(F.col(f"`{id_col}`").alias("l_id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    ids = ids.filter(~held_out("l_id")).groupBy("l_id").agg(F.max("label").alias("label"))
    mark = F.xxhash64(F.col("l_id").cast("string"), F.lit("toxicity"))
    return ids.withColumn("mark", mark).orderBy("mark", "l_id").limit(sample).select(
        "l_id", "label", F.pmod("mark", F.lit(2)).cast("int").alias("half"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    drawn = labelled_sample(labels, id_col, label_col, sample)
    drawn = docs.sparkSession.createDataFrame(drawn.collect(), drawn.schema)  # at most `sample` rows of 16 bytes
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("text"))
    marked = rows.join(F.broadcast(drawn), F.col("_id") == F.col("l_id"), "left").select("text", "label", "half")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, memo = np.zeros((5, BUCKETS), np.int64), Buckets()
        for pdf in batches:
            found = [tokens(t, memo) for t in pdf["text"]]
            n[0] += np.bincount(np.concatenate(found), minlength=BUCKETS)
            label, half = pdf["label"].fillna(-1).to_numpy(), pdf["half"].fillna(-1).to_numpy()
            for c in range(4):
                some = [found[i] for i in np.flatnonzero((half == c // 2) & ((label > 0) == c % 2) & (label >= 0))]
                if some:
                    n[1 + c] += np.bincount(np.concatenate(some), minlength=BUCKETS)
        some = np.flatnonzero(n[0])
        yield pd.DataFrame({"bucket": some, **{f"n{i}": n[i][some] for i in range(5)}})

    kind = "bucket bigint, " + ", ".join(f"n{i} bigint" for i in range(5))
    got = marked.mapInPandas(count, kind).groupBy("bucket").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(5)]).toPandas()
    n = np.zeros((5, BUCKETS))  # at most BUCKETS rows come back
    n[:, got["bucket"].to_numpy(np.int64)] = got[[f"n{i}" for i in range(5)]].to_numpy(np.float64).T
    halves = [token_scores(n[4], n[3], n[0]), token_scores(n[2], n[1], n[0])]  # each learned from the other half
    rates = [gumbel_lambda(s, n[0]) for s in halves]

    def out_of_half(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Buckets()
        for pdf in batches:
            out = []
            for text, label, half in zip(pdf["text"], pdf["label"], pdf["half"]):
                t = tokens(text, memo)
                out.append((int(label > 0), len(t), [rates[half] * s for s, _, _ in segments(halves[half][t])]))
            yield pd.DataFrame(out, columns=["label", "n", "bits"])

    seen = rows.join(F.broadcast(drawn), F.col("_id") == F.col("l_id")).select("text", "label", "half")
    # the segments of the sampled texts stay in the shared folder; to the driver come four numbers a text
    seen = stage(seen.mapInPandas(out_of_half, "label int, n bigint, bits array<double>"), "segments")
    best = seen.select("label", "n", F.coalesce(F.array_max("bits"), F.lit(0.0)).alias("best")).toPandas()
    best = best.sort_values(["label", "n", "best"])
    scores = token_scores(n[2] + n[4], n[1] + n[3], n[0])
    y = best["label"].to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.0
        flat = np.zeros((4, 4))
        flat[1], flat[3] = 1.0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(np.full(BUCKETS, -DRIFT), 1.0, 1.0, flat)
    clean = best[best["label"] == 0]
    chance = np.maximum(clean["n"], 1) * np.exp(-np.maximum(clean["best"], 0.0))
    k = 1 / float(np.mean(chance))  # K n exp(-lambda S) of the best segment has mean 1 by chance

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [features(m, list(b), k) for m, b in zip(pdf["n"], pdf["bits"])]
            yield pd.DataFrame(np.array(rows).reshape(-1, 4), columns=["x0", "x1", "x2", "x3"]).assign(label=pdf["label"])

    x = seen.mapInPandas(evidence, "x0 double, x1 double, x2 double, x3 double, label int").toPandas()
    x = x.sort_values(["label", "x3", "x0", "x1", "x2"])
    return Model(scores, gumbel_lambda(scores, n[0]), k, _logistic(
        x[["x0", "x1", "x2", "x3"]].to_numpy(np.float64), x["label"].to_numpy(np.float64)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, passages (start and end
    in characters of the lower-cased text, expected number by chance)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, score double, passages array<struct<start:int,end:int,e:double>>"
    # plain arrays, as a broadcast is not pickled by value; BUCKETS doubles
    carried = docs.sparkSession.sparkContext.broadcast((model.scores, model.lam, model.k, model.curve))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, memo = Model(*carried.value), Buckets()
        for pdf in batches:
            scores, passages = [], []
            for text in pdf["text"]:
                t = tokens(text, memo)
                found = segments(model.scores[t])
                scores.append(1 / (1 + np.exp(-np.clip(model.logits(len(t), found), -30, 30))))
                chance = [(a, z, model.k * len(t) * np.exp(-model.lam * s)) for s, a, z in found]
                passages.append(places(text, [c for c in chance if c[2] < SIGNIFICANT]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores, "passages": passages})

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(scan, schema)


def places(text: str, found: list[tuple[int, int, float]]) -> list[dict]:
    """Token numbers to places in the lower-cased text."""
    if not found:
        return []
    wanted = {i for a, z, _ in found for i in (a, z - 1)}
    last, at, i = max(wanted), {}, 0
    for m in _TOKEN.finditer(text.lower()):
        for _ in range(1 + (len(m[0]) > STEM)):
            if i in wanted:
                at[i] = m.span()
            i += 1
        if i > last:
            break
    return [{"start": at[a][0], "end": at[z - 1][1], "e": float(e)} for a, z, e in found]
