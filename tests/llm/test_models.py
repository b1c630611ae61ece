"""The models' scores, tails and choices worked out by hand."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from reclaim.llm import language_id, ordinal_quality, toxicity
from tests.llm.fixtures import EDGE, SF, documents, held_out


def crc(s):
    return zlib.crc32(s.encode("utf-8", "replace")) % (1 << 18)


# ------------------------------------------------------------------ toxicity
def toxic_tokens(text):
    out = []
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out += [crc(w)] + [crc("^" + w[:5])] * (len(w) > 5)
    return out


def maximal(scores):
    """The best segment, then those of what is left on both sides of it."""
    best = max(((sum(scores[a:z]), a - z, -a, a, z) for a in range(len(scores)) for z in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    _, _, _, a, z = best
    return maximal(scores[:a]) + [best[0]] + maximal(scores[z:])


def log_odds(toxic, clean, background):
    total, out = sum(background.values()), {}
    prior = {b: 5000.0 * background[b] / max(total, 1) + 1e-4 for b in range(1 << 18)}
    all_a, all_b = sum(toxic.values()) + sum(prior.values()), sum(clean.values()) + sum(prior.values())
    for b in background:
        x, y = toxic[b] + prior[b], clean[b] + prior[b]
        odds = math.log(x / (all_a - x)) - math.log(y / (all_b - y))
        odds = math.copysign(max(abs(odds) - 1.5 * math.sqrt(1 / x + 1 / y), 0), odds)
        out[b] = min(max(odds, -6), 6) - 0.5
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache(), spark.read.parquet(f"{SF}/labels.parquet").cache()


def test_toxicity_model_by_hand(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    text = {r.doc_id: toxic_tokens(r.text) for r in docs.collect()}
    background = Counter(b for t in text.values() for b in t)
    drawn = [r for r in labels.withColumn("half", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(2))).collect()
             if not held_out(r.doc_id) and r.doc_id in text]
    count = lambda rows: Counter(b for r in rows for b in text[r.doc_id])
    toxic, clean = [r for r in drawn if r.toxic], [r for r in drawn if not r.toxic]
    want = log_odds(count(toxic), count(clean), background)
    assert max(abs(model.scores[b] - v) for b, v in want.items()) < 1e-9
    total = sum(background.values())
    root = lambda odds, lam: sum(n / total * math.exp(lam * odds[b]) for b, n in background.items())
    assert root(want, model.lam) == pytest.approx(1, abs=1e-6) and model.lam > 0
    # K: of clean texts, scored by what the other half has taught, K n exp(-lambda S) has mean 1
    chance = []
    for half in (0, 1):
        other = log_odds(count([r for r in toxic if r.half != half]), count([r for r in clean if r.half != half]), background)
        lam = toxicity.gumbel_lambda(np.array([other.get(b, -0.5) for b in range(1 << 18)]), np.array([background[b] for b in range(1 << 18)], float))
        for r in clean:
            if r.half == half:
                s = [other[b] for b in text[r.doc_id]]
                best = max((sum(s[a:z]) for a in range(len(s)) for z in (range(a + 1, len(s) + 1) if len(s) < 120 else [])), default=0.0)
                if len(s) >= 120:  # the best segment by running minima
                    low = up = best = 0.0
                    for v in s:
                        up += v
                        best, low = max(best, up - low), min(low, up)
                chance.append(max(len(s), 1) * math.exp(-lam * max(best, 0.0)))
    assert model.k == pytest.approx(1 / (sum(chance) / len(chance)), rel=1e-6)


def test_toxicity_scores_by_hand(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    some = docs.filter("length(text) < 500").unionByName(documents(spark, EDGE[:8], clash=False))
    mean, scale, weight, offset = model.curve
    checked = 0
    for r in toxicity.score(some.select(F.col("text").alias("doc_id"), "text"), model).collect():
        t = toxic_tokens(r.doc_id)
        if len(t) > 150:
            continue
        n, worth = max(len(t), 1), [model.lam * s - math.log(model.k * max(len(t), 1)) for s in maximal([model.scores[b] for b in t])]
        strong = [w for w in worth if w > math.log(2)]
        x = [max([-8.0, *worth]), math.log1p(sum(strong)), 100 * len(strong) / n, math.log(n)]
        z = sum((a - m) / s * w for a, m, s, w in zip(x, mean, scale, weight)) + offset[0]
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(max(z, -30), 30))), abs=1e-6)
        assert len(r.passages) == len(strong)
        checked += 1
    assert checked >= 20


def test_what_fitting_sends_to_the_driver_is_bounded(spark, monkeypatch):
    """A text of 300,000 words: four numbers, and no more than FEATURES features."""
    rows = [(i, ("bad words %d " % i if i % 2 else "good words %d " % i) * (100_000 if i == 1 else 3), "en", "s") for i in range(60) if not held_out(i)]
    docs = documents(spark, rows, clash=False)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, *_ in rows], "doc_id long, quality int, toxic int")
    sent = []
    from pyspark.sql.classic.dataframe import DataFrame
    plain = DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: sent.append(plain(self)) or sent[-1])
    toxicity.fit(docs, labels)
    assert all(not any(hasattr(v, "__len__") for v in pdf.iloc[0]) for pdf in sent if len(pdf))
    sent.clear()
    words = [(i, " ".join(f"{t.split()[0]}{j}" for j in range(20_000 if n == 0 else 5)), "en", "s") for n, (i, t, *_) in enumerate(rows)]
    monkeypatch.setattr(ordinal_quality, "fit_ordinal", lambda rows, *_: sent.append(rows))
    ordinal_quality.fit(documents(spark, words, clash=False), labels.select("doc_id", F.col("quality").alias("grade")))
    assert max(len(at) for at, _ in sent[-1]) == ordinal_quality.FEATURES and len(sent) == 1


# ---------------------------------------------------------------- language ID
def test_language_choice_by_hand(spark, tables):
    docs, _ = tables
    content = language_id.learn(docs)
    assert len(content) > 1
    def size(text, name, level):
        d = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(text[a:a + 4096])) for a in range(0, len(text), 4096))

    rows = docs.filter("doc_id % 4 = 0").unionByName(documents(spark, EDGE, clash=False))
    for r in language_id.identify(rows, content).collect():
        plain = re.sub(r"[\W\d_]+", " ", (r.text or "").lower()).strip()
        if not any(c.isalpha() for c in plain):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = {n: 0 for n in sorted(content)}
        for level in (5, 12):
            for n in sizes:
                sizes[n] += size(plain.encode(), n, level)
            best = min(sizes, key=sizes.get)
            rest = min(v for n, v in sizes.items() if n != best)
            margin = (rest - sizes[best]) / rest
            if margin >= 0.004:
                break
        assert r.lang_pred == best and r.score == pytest.approx(margin / (margin + 0.02)) and r.rejected == (margin < 0.004)


# ------------------------------------------------------------------- quality
def quality_features(text):
    words = (text or "").split()
    if not words:
        return {}
    def shape(w):
        sign = lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a"
        return re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", sign, w))[:12]
    both = [(crc("w" + w.lower()), crc("s" + shape(w))) for w in words]
    n = Counter()
    for before, now in zip([both[0], *both], both):
        n.update([now[0], now[1], (before[1] * 31 + now[1] * 17 + 7) % (1 << 18), crc("repeat" if before[0] == now[0] else "fresh")])
    n[crc(f"distinct {10 * len({a for a, _ in both}) // len(words)}, {int(math.log2(len(words)))}")] += len(words)
    total = sum(n.values())
    return {b: math.sqrt(c / total) for b, c in n.items()}


def likelihood(rows, weights, thresholds):
    out = 0.0
    for x, y in rows:
        tails = [1.0, *(1 / (1 + math.exp(-(sum(weights[b] * v for b, v in x.items()) - t))) for t in thresholds), 0.0]
        out += math.log(max(tails[y] - tails[y + 1], 1e-12))
    return out


def test_quality_tails_and_likelihood_by_hand(spark, tables):
    docs, labels = tables
    graded = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    model = ordinal_quality.fit(docs, graded)
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = docs.unionByName(documents(spark, EDGE, clash=False))
    for r in ordinal_quality.grade(rows.select(F.col("text").alias("doc_id"), "text"), model).collect():
        eta = sum(model.weights[b] * v for b, v in quality_features(r.doc_id).items())
        tails = [1 / (1 + math.exp(-(eta - t))) for t in model.thresholds]
        assert r.tails == pytest.approx(tails, abs=1e-6) and r.tail == r.tails[0] and r.selected == (r.tail >= 0.5)
        assert r.expected_grade == pytest.approx(sum(tails), abs=1e-6)
    text = {r.doc_id: r.text for r in docs.collect()}
    seen = [(quality_features(text[r.doc_id]), r.grade) for r in graded.collect() if not held_out(r.doc_id) and text.get(r.doc_id)]
    share = [sum(y >= g for _, y in seen) / len(seen) for g in (1, 2)]
    alone = likelihood(seen, np.zeros(1 << 18), [-math.log(s / (1 - s)) for s in share])
    assert likelihood(seen, model.weights, model.thresholds) > alone / 3  # logarithms: nearer to 0
