"""Null and repeated ids, very long texts, edge rows through the pipeline's stages, row by row."""

from collections import Counter

import corpus_pipeline
from reclaim.llm import collision_counting, line_windows, secret_scan
from tests.llm.fixtures import EDGE, documents, fingerprint, held_out, linked
from tests.llm.test_dedup import brute_lines, normal, vectors
from tests.llm.test_text import PAIRS, brute_secrets


def test_vectors_with_null_and_repeated_ids(spark):
    a, b, c, d = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 1.0, 1.0]
    rows = [(None, a), (7, b), (7, b), (9, b), (None, c), (3, c), (None, d), (None, d), (4, None), (None, None), (4, None)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in collision_counting.near_vectors(vectors(spark, rows)).collect())
    assert got == Counter({
        (None, 0, None, True): 2,                       # alone, and a null vector
        (7, 2, 7, True): 2, (9, 2, 7, False): 1,        # both rows of the smallest id are kept
        (None, 1, 3, False): 1, (3, 1, 3, True): 1,     # a null id gives way to another
        (None, 1, None, True): 2,                       # no id in the component
        (4, 0, 4, True): 2})


def test_lines_of_repeated_ids_and_very_long_texts(spark):
    long = "\n".join(f"line {i % 5000}" for i in range(20_000))
    rows = [(1, "a\nb\nc", "en", "s"), (1, "a\nb\nc", "en", "s"), (1, "x\na\nb\nc\ny", "en", "s"), (2, "a\nb\nc", "en", "s"), (None, "a\nb\nc", "en", "s")]
    got = [(r.doc_id, r.text, r.n_removed) for r in line_windows.dedup_lines(documents(spark, rows)).collect()]
    # of the rows with the smallest id one keeps its lines, whichever comes first when they are staged
    assert sum("a\nb\nc" in (t or "") for _, t, _ in got) == 1 and sum(n for *_, n in got) == 12
    assert {(i, t) for i, t, _ in got if i != 1} == {(2, ""), (None, "")}
    rows = [(1, long, "en", "s"), (2, "fresh\n" + long, "en", "s")]
    got = {(r.doc_id, r.text, r.n_removed) for r in line_windows.dedup_lines(documents(spark, rows)).collect()}
    assert got == brute_lines(rows) and any(n > 14_000 for *_, n in got)


def test_secrets_of_null_and_repeated_ids(spark):
    rows = [(i, t, "en", "s") for t, _ in PAIRS for i in (None, 5, 5)]
    got = Counter((r.doc_id, r.spans) for r in secret_scan.report(secret_scan.scan(documents(spark, rows))).collect())
    assert got == Counter((i, brute_secrets(t)[4]) for i, t, *_ in rows)


def test_edge_rows_through_the_dedup_stages(spark, tmp_path):
    """The rows themselves, with their extra columns."""
    docs = documents(spark, EDGE)
    stage = dict(corpus_pipeline.STAGES)
    key = lambda r: tuple(r)
    rows = [key(r) for r in docs.collect()]
    out = [key(r) for r in stage["exact_dedup"](spark, docs, "").collect()]
    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted(out, key=str) == sorted(want, key=str)
    out = [key(r) for r in stage["simhash_near_dedup"](spark, docs, "").collect()]
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [fingerprint(r[1]) for r in order]
    root = linked(len(order), [(a, b) for a in range(len(order)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert sorted(out, key=str) == sorted((r for i, r in enumerate(order) if root[i] == i), key=str)


def test_edge_rows_through_the_language_stage(spark):
    docs = documents(spark, EDGE)
    kept = {tuple(r) for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "").collect()}
    rows = [tuple(r) for r in docs.collect()]
    assert kept <= set(rows)
    # texts without a letter are rejected; the others only where two languages are near
    assert not any(r[1] is None or not any(c.isalpha() for c in r[1]) for r in kept)
    assert any(not held_out(r[0]) for r in kept)
