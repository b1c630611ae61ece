"""Sharding, Merkle manifest, importance resampling and global ranks."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reclaim.llm import merkle, queries, resample, sharding
from reclaim.llm.ranks import ranked
from tests.llm.fixtures import SF, documents, invented


# --------------------------------------------------------------------- ranks
def test_ranks_are_gapless_with_ties_and_repeated_rows(spark):
    rows = [("a", 5)] * 300 + [("a", i % 7) for i in range(100)] + [("b", 1), ("c", None)]
    got = ranked(spark.createDataFrame(rows, "g string, x int"), "g", [F.col("x").asc_nulls_first()], "t").collect()
    for g in "abc":
        own = sorted((r["rank"], r.x) for r in got if r.g == g)
        assert [k for k, _ in own] == list(range(len(own)))
        assert [x for _, x in own] == sorted((x for _, x in own), key=lambda x: (x is not None, x or 0))
        assert {r.n for r in got if r.g == g} == {len(own)}


# -------------------------------------------------------------------- Merkle
def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def brute_tree(nodes, arity=3):
    """The root, and for each leaf the siblings before and after it, level by level."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a:a + arity]
            for j in range(len(run)):
                for i in under[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(H("".join(run)))
            over.append(sum(under[a:a + arity], []))
        nodes, under = up, over
    return nodes[0], paths


def brute_manifest(rows, arity=3):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text)))
    own = {s: brute_tree([brute_leaf(r, r.text) for r in by[s]], arity) for s in sources}
    root, tops = brute_tree([own[s][0] for s in sources], arity)
    out = []
    for s, top in zip(sources, tops):
        for r, path in zip(by[s], own[s][1]):
            t, path = r.text, path + top
            if r.doc_id is not None and t is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                t = t.replace("\n", "")
            x = brute_leaf(r, t)
            for before, after in path:
                x = H(before + x + after)
            out.append((r.doc_id, brute_leaf(r, r.text), own[s][0], root, H("".join(a + b for a, b in path)), x, x == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity, levels", [(3, 6), (3, 1), (3, 2), (2, 3)])
def test_manifest_equals_brute_force(spark, arity, levels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = merkle.report(merkle.manifest(docs, arity=arity, levels=levels)).collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest(docs.collect(), arity)


def test_manifest_edge_rows(spark):
    docs = documents(spark)  # nulls, repeated rows and ids, empty and very long texts, clashing names
    got = sorted(map(tuple, merkle.report(merkle.manifest(docs, levels=2)).collect()), key=str)
    assert got == brute_manifest(docs.collect()) and not all(r[-1] for r in got)
    one = documents(spark, [(4, "one\nline", "en", "a")])
    (r,) = merkle.report(merkle.manifest(one)).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H("") and r.verified == (zlib.crc32(b"4") % 2 == 1)
    assert merkle.report(merkle.manifest(documents(spark, []))).collect() == []


def test_proofs_find_any_change(spark):
    docs = documents(spark, invented(200), clash=False)
    proofs = merkle.manifest(docs, levels=3).cache()
    leaves = proofs.select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.sha2(F.col("leaf").cast("binary"), 256))
                           .otherwise(F.col("leaf")).alias("leaf")).union(spark.createDataFrame([(10 ** 9, "0" * 64)], "doc_id bigint, leaf string"))
    got = {r.doc_id: r.verified for r in merkle.verify(spark, leaves, proofs).collect()}
    assert {i for i, ok in got.items() if not ok} == {i for i in range(200) if i % 10 == 3} | {10 ** 9}


def test_documents_meet_no_join_on_the_way_to_their_proofs(spark):
    docs = documents(spark, invented(40), clash=False)
    rows = merkle.roll_up(docs.select(F.lit("g").alias("g"), F.col("doc_id").alias("rank"), F.lit(40).cast("long").alias("n"),
                                      F.md5("text").alias("digest"), "doc_id"), ["doc_id"], "t", 3, 4)
    above = rows.select("g", "block", F.array().cast(merkle.PATH).alias("path"))
    plan = merkle.come_down(rows, above, ["doc_id"], 3, 4)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" in plan


# ---------------------------------------------------------------- resampling
def brute_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_crcs(words, most=3):
    return [zlib.crc32(" ".join(words[i:i + n]).encode()) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, k=10000, least=20, percent=5):
    def count(texts):
        n = Counter(c % k for t in texts for c in brute_crcs(brute_words(t)))
        return n, sum(n.values())
    (s, S), (t, T) = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + k) / ((s[b] + 1) * (T + k)))) for b in range(k)]
    rows = []
    for i, x in docs:
        w = brute_words(x)
        f = brute_crcs(w)
        weight = sum(gain[c % k] for c in f)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((len(w), i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    places = {id(r): n for n, r in enumerate(able[:percent * len(able) // 100], 1)}
    return sorted(((*r[1:], places.get(id(r))) for r in rows), key=str)


def test_resampling_equals_brute_force(spark):
    got = queries.op13_importance_resampling(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, got), key=str) == brute_resample(docs, target)


def test_resampling_edge_rows(spark):
    docs = documents(spark)
    target = docs.filter("doc_id in (5, 12)").withColumnRenamed("doc_id", "item_id")
    got = resample.resample(docs, target, percent=60).select("doc_id", "n_features", "weight", "score", "rank").collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == brute_resample(rows, [r.text for r in target.collect()], percent=60)
    assert resample.resample(documents(spark, []), target).collect() == []
    alone = resample.resample(docs, target.filter("false")).collect()  # no target
    assert len(alone) == docs.count() and all(r.weight == 0 for r in alone if not r.n_features)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 18])
def test_substring_crcs_from_two_prefixes(size):
    table, shifts = resample._letters(), resample.Shifts()
    for text in ("", " !? ", "a", "One two,THREE  four-fünf 日本語 7x7 " * 9, "y" * 70000 + " z " + "q" * 130):
        crcs, lengths = resample.running(text.encode(), table)
        got = Counter(int(c) for f in shifts.features(crcs, lengths, 3, size) for c in f)
        assert got == Counter(brute_crcs(brute_words(text)))


def test_running_crcs_do_not_depend_on_the_cut_of_long_texts(monkeypatch):
    text = ("Some words, with: separators\nand more of them " * 50).encode()
    whole = resample.running(text, resample._letters())
    monkeypatch.setattr(resample, "text_chunks", lambda d: [d[:101].rsplit(b" ", 1)[0], d[len(d[:101].rsplit(b" ", 1)[0]):]])
    assert all((a == b).all() for a, b in zip(whole, resample.running(text, resample._letters())))


# ------------------------------------------------------------------ sharding
def held(got):
    """Bytes and slots by shard, and the shards of each group of equal texts."""
    size, slots, groups = Counter(), defaultdict(list), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r.size].append(r.shard)
    return size, slots, {k: v for k, v in groups.items() if len(v) > 1}


def check_sharded(got, rows, n_shards):
    size, slots, groups = held(got)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert set(size) <= set(range(n_shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size, groups


def test_shards_are_even_and_keep_copies_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op11_sharding(spark, "/root/testdata/sf0.01").collect()
    size, groups = check_sharded(got, [(r.doc_id, r.text) for r in docs.collect()], 40)
    mean = sum(size.values()) / 40
    assert len(size) == 40 and max(size.values()) <= 1.01 * mean and min(size.values()) >= 0.99 * mean
    assert groups and all(len(set(s)) == 1 for s in groups.values())
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert sorted(got) == sorted(queries.op11_sharding(spark, "/root/testdata/sf0.01").collect())


def test_a_third_of_all_rows_in_one_group(spark):
    rows = [(i, "the same text in every third row" if i % 3 == 0 else f"text number {i}") for i in range(3000)]
    got = sharding.shard(documents(spark, [(i, t, "en", "s") for i, t in rows]), 10).collect()
    size, groups = check_sharded(got, rows, 10)
    mean = sum(size.values()) / 10
    assert max(size.values()) <= 1.02 * mean
    (hot,) = groups.values()
    least = math.ceil(len(hot) * (32 + 16) / mean)  # shards that it fills
    assert least <= len(set(hot)) <= least + 1


def test_nothing_but_groups(spark):
    rows = [(i, f"pair number {i // 2:05d}") for i in range(4000)]
    got = sharding.shard(documents(spark, [(i, t, "en", "s") for i, t in rows], clash=False), 8).collect()
    size, groups = check_sharded(got, rows, 8)
    mean = sum(size.values()) / 8
    assert max(size.values()) <= 1.02 * mean and min(size.values()) >= 0.98 * mean
    assert sum(len(set(s)) == 1 for s in groups.values()) >= 0.9 * len(groups)  # 1 in 8 by chance


def test_links_between_different_texts(spark):
    """Sixty clusters of ten rows, each with two hubs that share two rows."""
    rows = [(i, f"link {i:05d} of a cluster", "en", "s") for i in range(600)]

    def clusters(found):
        k = F.col("doc_id") % 10
        hubs = F.array_compact(F.array(F.when(k < 6, F.lit("a")), F.when(k > 3, F.lit("b"))))
        return found.select("row", F.explode(hubs).alias("h2"), F.floor(F.col("doc_id") / 10).alias("c")).select(
            "row", F.concat("h2", "c").alias("hub"))

    got = {r.doc_id: r.shard for r in sharding.shard(documents(spark, rows, clash=False), 6, links=clusters).collect()}
    near = sum(got[i] == got[i + 1] for i in range(599) if i % 10 < 9) / 540
    assert near > 0.8 and len(got) == 600  # 1 in 6 by chance


def test_sharding_edge_rows(spark):
    docs = documents(spark)
    got = sharding.shard(docs, 3).collect()
    check_sharded(got, [(r.doc_id, r.text) for r in docs.collect()], 3)
    assert sharding.shard(documents(spark, [])).collect() == []
    lone = sharding.shard(documents(spark, [(1, None, None, None)])).collect()
    assert [(r.doc_id, r.size, r.text_crc32, r.slot) for r in lone] == [(1, 16, 0, 0)]
    assert {r.shard for r in sharding.shard(docs, 1).collect()} == {0}


def test_quotas_and_levels():
    want = np.array([[0, 10, 4], [6, 0, 0], [0, 8, 0]])
    got = sharding.quotas(want, np.array([0, 6, 100]))
    assert (got <= want).all() and got[0, 1] >= 6 and got[1, 0] == 6 and got[0, 2] == 4
    assert got[0, 1] + got[2, 1] - 6 <= 6  # beyond the swap, no more than the room
    assert sharding.water_level(np.array([5, 1, 9]), 6).tolist() == [1, 5, 0]
    assert sharding.water_level(np.array([5, 1, 9]), 3).tolist() == [0, 3, 0]
    assert sharding.water_level(np.array([0, 0]), 0).tolist() == [0, 0]
