"""The corpus pipeline, stage by stage against brute force."""

import importlib.util

import duckdb
import pytest

import corpus_pipeline
from reclaim.llm import common, language_id
from reclaim.llm.oracle import SQL
from tests.llm.fixtures import EDGE, documents, fingerprint, invented, linked
from tests.llm.test_dedup import normal
from tests.llm.test_text import check_packing, reference_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark, tmp_path, rows):
    """A folder with a documents table, as sf_dir has it."""
    documents(spark, rows, clash=False).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def stages(spark, sf_dir, tmp_path):
    """Each stage's output, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, out[-1], sf_dir).write.parquet(str(tmp_path / f"stage{i}"))
        out.append(spark.read.parquet(str(tmp_path / f"stage{i}")))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", s) for i, t, _, s in invented(220, seed=21)]
    rows += [(1000 + i, t, "xx", "s9") for i, (_, t, *_) in enumerate(
        (0, " ".join(w[::-1].upper() + "o" for w in r[1].split()), 0, 0) for r in invented(60, seed=22))]
    rows += [(5000, None, "en", "s1"), (5001, "123 456", "en", "s1"), (5002, "", None, None), (7, rows[7][1], "en", "s2")]
    sf_dir = table(spark, tmp, rows)
    return sf_dir, stages(spark, sf_dir, tmp), tmp


def test_language_stage(spark, made):
    _, out, _ = made
    encoder = language_id.Encoder(language_id.learn(out[0]))
    kept = [r for r in rows_of(out[0]) if (c := encoder.classify(r[1]))[0] != "und" and c[1] >= language_id.MIN_MARGIN]
    assert rows_of(out[1]) == kept and len(kept) >= 270


def test_exact_stage(spark, made):
    _, out, _ = made
    best = {}
    for r in sorted(rows_of(out[1]), key=lambda r: (r[0], str(r[2:]))):
        best.setdefault(normal(r[1]), r)
    assert rows_of(out[2]) == sorted(best.values(), key=str) and len(best) < len(rows_of(out[1]))


def test_near_stage(spark, made):
    _, out, _ = made
    rows = sorted(rows_of(out[2]), key=lambda r: r[0])
    prints = [fingerprint(r[1]) for r in rows]
    root = linked(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    want = sorted((r for i, r in enumerate(rows) if root[i] == i), key=str)
    assert rows_of(out[3]) == want and len(want) < len(rows) - 20


def test_mix_stage(spark, made, tmp_path):
    _, out, tmp = made
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp}/stage2/*.parquet')")
    copies = {i: n for i, _, _, _, n, _ in con.execute(SQL["op5_pareto_mix"]).fetchall()}
    want = sorted((r for r in rows_of(out[3]) for _ in range(copies[r[0]])), key=str)
    assert rows_of(out[4]) == want and 0 in copies.values() and max(copies.values()) > 1


def test_packing_stage(spark, made):
    _, out, _ = made
    rows = rows_of(out[4])
    times = {}
    for r in rows:
        times[r[0]] = times.get(r[0], 0) + 1
    got = out[5].collect()
    # a document taken several times has each of its pieces as often
    assert sorted(r.doc_id for r in got if r.piece == 0) == sorted(r[0] for r in rows)
    check_packing(rows, got, 1024, reference_ids())


def test_run_equals_its_stages(spark, made):
    sf_dir, out, _ = made
    got = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, out[5].select(*key).collect()))
    assert got.select("sequence_id").distinct().count() == out[5].select("sequence_id").distinct().count()


def test_edge_rows_and_clashing_columns_pass_through(spark, tmp_path):
    docs = documents(spark, EDGE)
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
        assert out.count() > 0
        docs = out


def test_empty_table(spark, tmp_path):
    sf_dir = table(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
    for df in stages(spark, sf_dir, tmp_path):
        assert df.count() == 0


def test_staged_tables_of_earlier_stages_go(spark, made, tmp_path):
    sf_dir, _, _ = made
    before = len(common.staged())
    stages(spark, sf_dir, tmp_path)
    # those of the last stage alone are left: nothing says when its result is used up
    assert len(common.staged()) - before <= 2
    assert importlib.util.find_spec("corpus_pipeline")


def test_pipelines_in_three_threads(spark, made, tmp_path):
    """They do not meet: the same results as alone, and only these are left."""
    import os
    from concurrent.futures import ThreadPoolExecutor
    sf_dir, out, _ = made
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda _: corpus_pipeline.run(spark, sf_dir), range(3)))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = sorted(map(tuple, out[5].select(*key).collect()))
    assert all(sorted(map(tuple, g.select(*key).collect())) == want for g in got)
    left = [x for x in set(os.listdir(folder)) - before if x.startswith("reclaim-")]
    assert len(left) == 3 and all(x.startswith("reclaim-pipeline-best_fit_packing") for x in left)
