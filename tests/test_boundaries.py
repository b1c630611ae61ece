"""Hand-made boundary cases with known answers (FIXTURES.md §1 and §5)."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reclaim.functions import (MIB, age_days_over, format_bytes, format_duration, name_glob_any,
                               not_under, path_glob, size_label, size_over, status_label, version_key)
from reclaim.operators import (Rule, RuleBook, SelectionError, approval_gate, before_current,
                               capped_share, contents_of, drop_all_but_latest, first_match,
                               over_budget, reclaim_by_rule, run_report, select_rules,
                               under_marked_dirs, unreferenced)
from reclaim.sources import json_env_names, ws_field

AS_OF = dt.datetime(2024, 1, 31)


def col_values(df, c):
    return [r[c] for r in df.collect()]


def test_format_bytes_reference_cases(spark):
    # fixed values that must equal the reference's: byte texts
    cases = [(500, "500 B"), (1024, "1.0 KiB"), (2 ** 20, "1.0 MiB"), (2 ** 30, "1.0 GiB"),
             (2 ** 40, "1.0 TiB"), (2 ** 50, "1.0 PiB"), (2 ** 60, "1.0 EiB"),
             (1023, "1023 B"), (1280, "1.2 KiB"), (1792, "1.8 KiB"), (1048575, "1024.0 KiB")]
    df = spark.createDataFrame([(n,) for n, _ in cases], "bytes long")
    got = [r[0] for r in df.select(format_bytes("bytes")).collect()]
    assert got == [e for _, e in cases]


def test_format_bytes_rounds_the_double_as_printf_does(spark):
    rnd = random.Random(11)
    cases = [int(1.15 * 2 ** 60), 2 ** 63 - 1, 1100 * 2 ** 50, 1024 ** 2 - 1] + [rnd.randrange(1024, 2 ** 63) for _ in range(500)]
    cases += [1024 ** k * 5 // 4 + d for k in range(1, 7) for d in (-1, 0, 1)] + [1024 ** k * 7 // 4 for k in range(1, 6)]
    df = spark.createDataFrame([(n,) for n in cases], "bytes long")
    for n, got in zip(cases, [r[0] for r in df.select(format_bytes("bytes")).collect()]):
        k = max(e for e in range(1, 7) if float(n) >= 1024.0 ** e or e == 1)
        assert got == f"{float(n) / 1024.0 ** k:.1f} {'KMGTPE'[k - 1]}iB", n


def test_size_label_zero(spark):
    df = spark.createDataFrame([(0,), (2048,)], "bytes long")
    assert col_values(df.select(size_label("bytes").alias("l")), "l") == ["Insignificant", "2.0 KiB"]


def test_format_duration_edges(spark):
    df = spark.createDataFrame([(0.999,), (1.0,), (59.9,), (60.0,)], "duration_s double")
    v, u = format_duration("duration_s")
    rows = df.select(v.alias("v"), u.alias("u")).collect()
    assert [(round(r.v, 6), r.u) for r in rows] == [(999.0, "ms"), (1.0, "s"), (59.9, "s"), (1.0, "m")]


def test_age_days_over_boundary(spark):
    t31 = AS_OF - dt.timedelta(days=31)
    df = spark.createDataFrame([(1, t31), (2, t31 + dt.timedelta(seconds=1)), (3, None)],
                               "id long, mtime timestamp_ntz")
    assert col_values(df.filter(age_days_over(30, AS_OF, "mtime")), "id") == [1]


def test_size_over_boundary(spark):
    df = spark.createDataFrame([(1, 10485760), (2, 10485761), (3, None)], "id long, size_bytes long")
    assert col_values(df.filter(size_over(10, MIB)), "id") == [2]


def test_path_glob_literal_percent_underscore(spark):
    df = spark.createDataFrame([("/a/50%_x",), ("/a/50ab_x",), ("/a/50%_y",)], "path string")
    assert col_values(df.filter(path_glob("*/50%_x")), "path") == ["/a/50%_x"]
    assert col_values(df.filter(name_glob_any(["50%_?"])), "path") == ["/a/50%_x", "/a/50%_y"]


def test_not_under_snap(spark):
    df = spark.createDataFrame([("/snap",), ("/snap/x",), ("/snapshot/x",)], "path string")
    assert col_values(df.filter(~not_under("/snap")), "path") == ["/snap/x"]


def test_contents_skip_hidden_first_level(spark):
    df = spark.createDataFrame([("/d/.h/f",), ("/d/a/.h",)], "path string")
    assert col_values(df.filter(contents_of("/d", skip_hidden=True)), "path") == ["/d/a/.h"]


def test_marker_dirs_cases(spark):
    rows = [(1, "h", "/home/u/p/build/x.o"),                       # build without marker: kept
            (2, "h", "/home/u/q/build/sub/CMakeCache.txt"),        # marker not directly in build
            (3, "h", "/home/u/r/build/CMakeCache.txt"),            # marked
            (4, "h", "/home/u/r/build/obj/a.o")]                   # below marked
    df = spark.createDataFrame(rows, "id long, host string, path string").withColumn("kind", F.lit("f"))
    got = sorted(col_values(under_marked_dirs(df, "/home", "build", "CMakeCache.txt").filter("_marked"), "id"))
    assert got == [3, 4]


def test_unreferenced_null_and_duplicates(spark):
    items = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    refs = spark.createDataFrame([(1,), (1,)], "k long")
    got = sorted(col_values(unreferenced(items, refs, "k"), "k"), key=lambda x: (x is None, x))
    assert got == [2, None]


def _book():
    return RuleBook([Rule("a", F.lit(True), requires_approval=True), Rule("b", F.lit(True)),
                     Rule("c", F.lit(True), requires_approval=True)])


def test_select_rules_modes(spark):
    cat = _book().catalogue(spark)
    with pytest.raises(SelectionError):
        select_rules(spark, cat, include="a,zz")
    with pytest.raises(SelectionError):
        select_rules(spark, cat, include="a, b")  # the blank is not trimmed
    with pytest.raises(SelectionError):
        select_rules(spark, cat, include="a", exclude="b")
    with pytest.raises(SelectionError):
        select_rules(spark, cat)
    inc = select_rules(spark, cat, include="a,b,a").orderBy("seq").collect()
    assert [(r.seq, r.name) for r in inc] == [(1, "a"), (2, "b"), (3, "a")]
    exc = select_rules(spark, cat, exclude="b").orderBy("seq").collect()
    assert [r.name for r in exc] == ["a", "c"]
    assert [r.name for r in select_rules(spark, cat, all_rules=True).orderBy("seq").collect()] == ["a", "b", "c"]


def test_approval_gate_answers(spark):
    book = RuleBook([Rule(n, F.lit(True), requires_approval=(n != "d")) for n in "abcd"])
    cat = book.catalogue(spark)
    sel = select_rules(spark, cat, include="a,b,c,d")
    ap = spark.createDataFrame([("a", None), ("b", "n"), ("c", "Y")], "name string, ans string")
    got = {r.name: r.skipped for r in approval_gate(sel, cat, ap).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


def test_run_report_zero_bytes(spark):
    st = spark.createDataFrame([(1, "a", True, None), (2, "b", False, "boom"), (3, "c", False, None),
                                (4, "d", False, None)], "seq long, name string, skipped boolean, error string")
    per = spark.createDataFrame([(1, 5, 50), (2, 5, 50), (4, 1, 10)], "seq long, files long, bytes long")
    got = {r.name: (r.status, r.bytes) for r in run_report(st, per).collect()}
    assert got == {"a": ("Skipped", 0), "b": ("Error", 0), "c": ("Success", 0), "d": ("Success", 10)}


def test_first_match_run_order(spark):
    df = spark.createDataFrame([(1, "/x")], "id long, path string")
    rules = [Rule("z", F.lit(True)), Rule("a", F.lit(True)), Rule("m", F.lit(True))]
    assert col_values(first_match(df, rules), "rule") == ["z"]


def test_drop_all_but_latest_small_group_and_ties(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "g", t), (2, "g", t), (3, "g", t), (4, "s", t)],
                               "id long, k string, ts timestamp_ntz")
    got = sorted(col_values(drop_all_but_latest(df, "k", "ts", 2), "id"))
    assert got == [1]  # equal timestamps: the higher ids are kept; group s smaller than n


def test_before_current_kernels(spark):
    names = ["linux-image-6.1.0-9-cloud", "linux-image-6.1.0-17-cloud", "linux-image-6.1.0-23-cloud"]
    df = spark.createDataFrame([(i, "k", n) for i, n in enumerate(names)], "id long, grp string, v string")
    got = col_values(before_current(df, "grp", version_key("v"), F.col("v") == names[2]), "v")
    assert sorted(got) == sorted(names[:2])
    none = before_current(df, "grp", version_key("v"), F.col("v") == "linux-image-0")
    assert none.count() == 0
    df2 = spark.createDataFrame([(1, "k", "2.8-9"), (2, "k", "2.8-10")], "id long, grp string, v string")
    assert col_values(before_current(df2, "grp", version_key("v"), F.col("v") == "2.8-10"), "v") == ["2.8-9"]


def test_version_key_orders_runs_of_any_length(spark):
    ordered = ["1", "1.0", "1.2", "1.9", "1.10", "1.10a", "1.10b", "2." + "9" * 24 + "1", "2." + "9" * 24 + "2", "2.1" + "0" * 25,
               "a", "a1", "a02", "a2", "a10"]
    df = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert col_values(df.orderBy(version_key("v")), "v") == ordered


def test_superseded_keeps_the_newest_of_long_versions(spark):
    from reclaim.operators import superseded
    base = "7." + "3" * 20
    df = spark.createDataFrame([(1, "g", base + "8"), (2, "g", base + "9"), (3, "g", "6.9")], "id long, k string, v string")
    assert sorted(col_values(superseded(df, "k", version_key("v")), "id")) == [1, 3]


def test_budget_equal_is_kept_and_first_over_dropped(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", t + dt.timedelta(hours=2), 60), (2, "a", t + dt.timedelta(hours=1), 40),
                                (3, "a", t, 1), (4, "b", t, 500)], "id long, k string, ts timestamp_ntz, size long")
    got = {r.id: r.drop for r in over_budget(df, "k", "ts", 100, weight="size").collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}


@pytest.mark.parametrize("span", [0, 1, 3 * 3600, 400 * 86400])
@pytest.mark.parametrize("keys", [["k"], None])
def test_over_budget_equals_plain_window(spark, keys, span):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        ts = None if rnd.random() < 0.03 else t0 + dt.timedelta(seconds=rnd.random() * span)
        size = None if rnd.random() < 0.03 else rnd.randrange(0, 1000)
        k = None if rnd.random() < 0.03 else rnd.choice("abc")
        rows.append((i, k, ts, size))
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, size long")
    budget = 20_000
    got = {r.id: r.drop for r in over_budget(df, keys, "ts", budget, "size").collect()}
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(
        F.col("ts").desc_nulls_last(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("run", F.sum(F.coalesce("size", F.lit(0))).over(w))
    want = {r.id: r.run > budget for r in ref.collect()}
    assert got == want


def test_over_budget_by_numbers_and_ties(spark):
    # epoch microseconds, doubles and texts as tiebreak; rows that tie with the last kept one stay
    rows = [(i, 1_700_000_000_000_000 + 5000 * i, i / 7, f"t{i:03d}", 10) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, us long, x double, tie string, size long")
    want = [r[0] for r in rows if (300 - r[0]) * 10 > 1005]
    for ts, tie in (("us", "id"), ("x", "id"), ("us", "tie"), ("x", "tie"), ("id", "us")):
        got = over_budget(df, None, ts, 1005, "size", tiebreak=tie).filter("drop")
        assert sorted(col_values(got, "id")) == want, (ts, tie)
    t = dt.datetime(2024, 1, 1)
    same = spark.createDataFrame([("a", t, 1, 60), ("a", t, 1, 60), ("a", t, 0, 1)], "k string, ts timestamp_ntz, id long, size long")
    got = sorted((r.id, r["drop"]) for r in over_budget(same, "k", "ts", 100, "size").collect())
    assert got == [(0, True), (1, False), (1, False)]


def plain_budget(df, keys, ts, tie, budget):
    """E4 by one window over all rows of a group."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(
        F.col(ts).desc_nulls_last(), F.col(tie).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    rows = Window.partitionBy(*keys, ts, tie) if keys else Window.partitionBy(ts, tie)
    ran = df.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # rows of one place are kept together if one of them is
    return {r.id for r in ran.withColumn("least", F.min("upto").over(rows)).filter(F.col("least") > budget).collect()}


@pytest.mark.parametrize("tie, kind", [
    (lambda i: (i * 0x9E3779B97F4A7C15) % 2 ** 64 - 2 ** 63, "long"), (lambda i: [-2 ** 63, -1, 0, 2 ** 63 - 1, None][i % 5], "long"),
    (lambda i: f"/home/u/projects/p{i % 3}/src/module/{i * 7919 % 1000:04d}", "string"),
    (lambda i: ["", "a", "a\0", "a\0b", "é", "\U0001f600", None, "z" * 70 + str(i)][i % 8], "string"),
    (lambda i: bytes([i * 31 % 256, 255 - i % 256]), "binary"), (lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i * 13 % 9000), "date")])
@pytest.mark.parametrize("levels, bits", [(None, 16), (2, 2)])
def test_budget_in_the_order_of_any_tiebreak(spark, tie, kind, levels, bits):
    """One time on most rows, so the tiebreak decides."""
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else None, None if i % 50 == 0 else t + dt.timedelta(microseconds=i % 40 == 7), tie(i), 5) for i in range(600)]
    df = spark.createDataFrame(rows, f"id long, k string, ts timestamp_ntz, tie {kind}, size long")
    for keys, budget in ((["k"], 900), ([], 37)):
        got = over_budget(df, keys, "ts", budget, "size", tiebreak="tie", levels=levels, bits=bits)
        assert {r.id for r in got.filter("drop").collect()} == plain_budget(df, keys, "ts", "tie", budget), keys


@pytest.mark.parametrize("keys", ["k", None])
def test_budget_of_one_time_deals_the_rows_of_a_group_over_tasks(spark, tmp_path, keys):
    """One group, one time, texts that start alike: all rows are in one bin of the first
    levels, and no task is sent them all."""
    import re
    path = str(tmp_path / "rows")
    spark.range(0, 40_000, 1, 8).select(F.lit("h").alias("k"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), "id",
                                        F.concat(F.lit("inventory-row-"), F.md5(F.col("id").cast("string").cast("binary"))).alias("tie"),
                                        F.lit(1).cast("long").alias("size")).write.parquet(path)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.read.parquet(path)
        marked = over_budget(df, keys, "ts", 12_345, "size", tiebreak="tie")
        assert {r.id for r in marked.filter("drop").select("id").collect()} == plain_budget(df, [keys] if keys else [], "ts", "tie", 12_345)
        plan = marked._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        # rows meet the bin of their group by their part too, or, of a single group, where they are
        by_bin = [x for x in re.findall(r"SortMergeJoin \[(.*?)\], \[", plan) if "_f#" in x or "_b#" in x]
        assert all("_part#" in x for x in by_bin) and len(by_bin) == (3 if keys else 0), by_bin
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_budget_puts_few_rows_in_order_and_reads_three_times(spark, tmp_path):
    """One time, 200,000 rows a group: no window gets more than 2^bits bins, or the rows of one."""
    import re
    path = str(tmp_path / "rows")
    spark.range(400_000).select((F.col("id") % 2).alias("k"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"),
                                F.xxhash64("id").alias("id"), F.lit(1).cast("long").alias("size")).write.parquet(path)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        marked = over_budget(spark.read.parquet(path), "k", "ts", 77_777, "size", bits=8)
        assert marked.groupBy("k").agg(F.sum(F.col("drop").cast("int"))).collect() == [(0, 122_223), (1, 122_223)]
        run = marked._jdf.queryExecution().executedPlan()
        plan = run.toString()
        assert plan.count("FileScan") == 3 and plan.count("ReusedExchange") == 2
        read = []

        def walk(node):
            if node.nodeName() == "Window":  # what the sort below a window got
                below = node.children().head()
                while "numOutputRows" not in [x for x in below.metrics().keySet().mkString(",").split(",")]:
                    below = below.children().head()
                read.append(below.metrics().apply("numOutputRows").value())
            for i in range(node.children().size()):
                walk(node.children().apply(i))
        marked.collect()
        walk(run)
        # two groups: bins of the time, 2^8 + 1 bins of the ids at most, then the rows of one such bin
        assert read and max(read) <= 2 * max(2 ** 8 + 1, 2 * 200_000 // 2 ** 8)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_keep_newest_has_one_path_for_every_n(spark):
    from reclaim.operators import drop_last_n
    t = dt.datetime(2024, 1, 1)
    rows = [(None, t + dt.timedelta(hours=9)), (1, t + dt.timedelta(hours=8)), (1, t), (2, t + dt.timedelta(hours=1)), (3, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz").withColumn("k", F.lit("a"))
    old = [(1, t), (2, t + dt.timedelta(hours=1)), (3, None)]
    key = lambda x: (str(x[1]), x[0])
    for got in (drop_last_n(df, "ts", 2), drop_all_but_latest(df, "k", "ts", 2), drop_all_but_latest(df, None, "ts", 2)):
        # a row that shares the id of a kept one goes, the newest without an id stays
        assert sorted(((r.id, r.ts) for r in got.collect()), key=key) == sorted(old, key=key)
    for n in (5, 1_000_000, 1_000_001):
        assert drop_last_n(df, "ts", n).count() == drop_all_but_latest(df, "k", "ts", n).count() == 0
    assert drop_last_n(df, "ts", 0).count() == drop_all_but_latest(df, "k", "ts", 0).count() == 5


def test_keep_newest_with_one_key_of_a_third(spark):
    rnd = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 0 if i % 3 == 0 else i % 501 + 1, t0 + dt.timedelta(seconds=rnd.randrange(10 ** 6))) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz")
    w = Window.partitionBy("k").orderBy(F.col("ts").desc(), F.col("id").desc())
    want = {r.id for r in df.withColumn("n", F.row_number().over(w)).filter("n > 3").collect()}
    assert set(col_values(drop_all_but_latest(df, "k", "ts", 3), "id")) == want


def test_no_job_runs_while_retention_frames_are_built(spark):
    from reclaim.operators import drop_last_n, freed_between
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", t, 5)], "id long, k string, ts timestamp_ntz, size long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may start")
    try:
        frames = [over_budget(df, "k", "ts", 3, "size"), over_budget(df, None, "ts", 3, "size"), drop_last_n(df, "ts", 1),
                  drop_all_but_latest(df, "k", "ts", 1), freed_between(df, "k", "ts", "size")]
        assert len(tracker.getJobIdsForGroup("building")) == 0
        assert all(f.collect() is not None for f in frames)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_capped_share_edges(spark):
    df = spark.createDataFrame([("r", 0.0), ("s", 0.0), ("s", 5.0), ("s", 10.0)], "run string, v double")
    got = sorted((r.run, r.v, r.share) for r in capped_share(df, "v", 4.0, keys=["run"]).collect())
    assert got[0] == ("r", 0.0, 0.0)
    assert [x[2] for x in got[1:]] == [0.0, 1.25, 2.5]


def test_status_label_order(spark):
    df = spark.createDataFrame([(True, "e"), (False, "e"), (False, None)], "skipped boolean, error string")
    assert col_values(df.select(status_label().alias("s")), "s") == ["Skipped", "Error", "Success"]


def test_sdk_listing_first_field(spark):
    lines = ["system-images;watch-9;plain;arm   | 4.1 | Installed", "  emulator-canary | 31.2 | Installed",
             "platform-tools | 35 | Installed", ""]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    hit = df.filter(F.col("line").contains("system-images") | F.col("line").contains("emulator"))
    assert col_values(hit.select(ws_field("line", 0).alias("p")), "p") == \
        ["system-images;watch-9;plain;arm", "emulator-canary"]


def test_conda_json_envs(spark):
    docs = ['{"envs": ["/opt/conda/envs/base", "/opt/conda/envs/env1", "/opt/conda/envs/env2"]}', '{"envs": []}']
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = df.select(F.explode(json_env_names("doc")).alias("e")).filter(F.col("e") != "base")
    assert col_values(got, "e") == ["env1", "env2"]


def test_reclaim_by_rule_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "rule string, size_bytes long")
    got = {r.rule: (r.files, r.bytes) for r in reclaim_by_rule(df).collect()}
    assert got == {"a": (2, 3), "b": (1, 0)}


def test_global_row_number_matches_sort(spark):
    from reclaim.operators import global_row_number
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = {r.id: r.pos for r in global_row_number(df, [F.col("v"), F.col("id")], partitions=7).collect()}
    want = {i: p for p, (v, i) in enumerate(sorted((v, i) for i, v in rows), start=1)}
    assert got == want


def test_freed_between_per_key_and_global(spark):
    from reclaim.operators import freed_between
    rows = [("a", 1, 100), ("a", 2, 150), ("a", 3, 120), ("b", 1, 10), ("b", 5, 40), ("b", 9, 45)]
    df = spark.createDataFrame(rows, "host string, seq long, free long")
    got = {(r.host, r.seq): r.freed for r in freed_between(df, "host", "seq", "free").collect()}
    assert got == {("a", 1): 0, ("a", 2): 50, ("a", 3): 0, ("b", 1): 0, ("b", 5): 30, ("b", 9): 5}
    one = spark.createDataFrame([(1, 5), (2, 3), (4, 9)], "seq long, free long")
    assert {r.seq: r.freed for r in freed_between(one, None, "seq", "free").collect()} == {1: 0, 2: 0, 4: 6}


def test_run_report_messages_and_report_sink(spark, tmp_path):
    from reclaim.sources import write_report
    st = spark.createDataFrame([(1, "a", True, None), (2, "b", False, "boom"), (3, "c", False, None)],
                               "seq long, name string, skipped boolean, error string")
    per = spark.createDataFrame([(3, 1, 10)], "seq long, files long, bytes long")
    rep = run_report(st, per)
    got = {r.name: r.message for r in rep.collect()}
    assert got == {"a": "Skipped", "b": "Error during cleanup: boom", "c": "Cleanup completed successfully"}
    out = write_report(rep, str(tmp_path / "report"))
    assert spark.read.json(out).count() == 3


def test_explode_lines(spark):
    from reclaim.sources import explode_lines
    df = spark.createDataFrame([(1, "a\nb\r\nc")], "id long, text string")
    assert [r.line for r in explode_lines(df, "text").collect()] == ["a", "b", "c"]


def test_directory_rows_prefer_own_mtime(spark):
    from reclaim.sources.tables import directory_rows, with_directories
    t = dt.datetime(2024, 1, 1)
    rows = [("h", "/home/u/d", "d", None, t, None, None),
            ("h", "/home/u/d/f", "f", 1, t + dt.timedelta(days=5), None, 1)]
    df = spark.createDataFrame(rows, "host string, path string, kind string, size_bytes long, "
                                     "mtime timestamp_ntz, atime timestamp_ntz, id long")
    got = {r.path: r.mtime for r in directory_rows(df).collect()}
    assert got["/home/u/d"] == t and got["/home/u"] == t + dt.timedelta(days=5)
    paths = [r.path for r in with_directories(df).filter("kind = 'd'").collect()]
    assert sorted(paths) == ["/home", "/home/u", "/home/u/d"]


def test_wine_flag_uses_directory_mtime(spark):
    from reclaim.plans.catalogue import file_rulebook
    old, new = dt.datetime(2023, 1, 1), dt.datetime(2024, 1, 30)
    rows = [("h", "/root/.wine", "d", None, old, 1), ("h", "/root/.wine/drive_c/x", "f", 5, new, 2),
            ("h", "/root/.wine2/y", "f", 5, new, 3), ("h", "/root/.winex/z", "f", 5, old, 4)]
    df = spark.createDataFrame(rows, "host string, path string, kind string, size_bytes long, "
                                     "mtime timestamp_ntz, id long").withColumn("atime", F.col("mtime"))
    hits = first_match(df, file_rulebook(AS_OF).rules(["wine"]))
    assert sorted(r.id for r in hits.collect()) == [1, 2, 4]


def test_dir_glob_above_root_is_not_a_match(spark):
    from reclaim.operators import dir_path_glob, under_dir
    df = spark.createDataFrame([("/home/u1/a/f", "f"), ("/home/u2/f", "f")], "path string, kind string")
    # "/home" is above the root: no directory at or below /home/u1 is called that
    assert df.filter(under_dir("/home/u1", dir_path_glob("/home"))).count() == 0
    got = [r.path for r in df.filter(under_dir("/home/u1", dir_path_glob("*/a"))).collect()]
    assert got == ["/home/u1/a/f"]


def test_dir_contents_nested_matches_count_in_each(spark):
    from reclaim.operators import dir_contents, named
    rows = [("h", "/home/u/.cache/x/.cache/f", 10), ("h", "/home/u/.cache/g", 5)]
    df = spark.createDataFrame(rows, "host string, path string, size_bytes long")
    got = {(r.dir, r.files, r.bytes) for r in dir_contents(df, "/home", named(".cache")).collect()}
    assert got == {("/home/u/.cache", 2, 15), ("/home/u/.cache/x/.cache", 1, 10)}


def test_autotools_names_files_dirs_and_subtrees(spark):
    from reclaim.plans.catalogue import AUTOTOOLS_NAMES, file_rulebook
    rows = [(i, f"/home/u/p/{n}", "f" if i % 2 else "d") for i, n in enumerate(AUTOTOOLS_NAMES)]
    rows += [(100, "/home/u/p/.deps/x.Po", "f"), (101, "/home/u/p/configure", "f"), (102, "/opt/p/config.log", "f")]
    df = spark.createDataFrame(rows, "id long, path string, kind string")
    got = sorted(r.id for r in first_match(df, file_rulebook(AS_OF).rules(["autotools"])).collect())
    assert got == list(range(len(AUTOTOOLS_NAMES))) + [100]


def test_tool_gate_modes(spark):
    from reclaim.operators import tool_gate, with_host_tools
    inv = spark.createDataFrame([("h0", 1), ("h1", 2), ("h2", 3), ("h3", 4)], "host string, id long")
    ht = spark.createDataFrame([("h0", "mysql"), ("h1", "mariadb"), ("h2", "docker")], "host string, tool string")
    i = with_host_tools(inv, ht)
    pick = lambda c: sorted(r.id for r in i.filter(c).collect())
    assert pick(tool_gate(["mysql", "mariadb"])) == [1, 2]      # either of two
    assert pick(tool_gate(["docker"])) == [3]                   # one
    assert pick(tool_gate(["vagrant"])) == []                   # none
    assert pick(tool_gate([])) == [1, 2, 3, 4]                  # no requirement


def test_union_step_frames_dedupes_on_key(spark):
    from reclaim.operators import union_step_frames
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, path string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "id long, path string")
    assert sorted(r.id for r in union_step_frames([a, b], "id").collect()) == [1, 2, 3]


def test_dir_name_glob_and_depth(spark):
    from reclaim.functions import depth_is
    from reclaim.operators import dir_name_glob, under_dir
    rows = [("/root/.wine/drive_c/f", "f"), ("/root/.wine", "d"), ("/root/x/.wine2/f", "f"), ("/root/.winex", "f")]
    df = spark.createDataFrame(rows, "path string, kind string")
    sub = sorted(r.path for r in df.filter(under_dir("/root", dir_name_glob(".wine*"), contents_only=False)).collect())
    assert sub == ["/root/.wine", "/root/.wine/drive_c/f", "/root/x/.wine2/f"]
    assert sorted(r.path for r in df.filter(depth_is("/root", 1)).collect()) == ["/root/.wine", "/root/.winex"]


def test_first_match_seq(spark):
    df = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, None)], "id long, path string")
    rules = [Rule("a", F.col("id") > 2), Rule("b", F.col("id") > 1), Rule("c", F.lit(True))]
    hits = {r.id: (r.rule, r.seq) for r in first_match(df, rules, seq="seq").collect()}
    assert hits == {1: ("c", 3), 2: ("b", 2), 3: ("a", 1)}


def test_capped_share_global_and_max_over_run(spark):
    from reclaim.operators import max_over_run
    df = spark.createDataFrame([("r1", 2.0), ("r1", 8.0), ("r2", 4.0)], "run string, v double")
    got = sorted((r.v, r.share) for r in capped_share(df, "v", 100.0).collect())
    assert got == [(2.0, 0.25), (4.0, 0.5), (8.0, 1.0)]
    per = {(r.run, r.v): r.max_v for r in max_over_run(df, "v", run="run").collect()}
    assert per == {("r1", 2.0): 8.0, ("r1", 8.0): 8.0, ("r2", 4.0): 4.0}


def test_named_dir_contents_skip_hidden(spark):
    from reclaim.operators import named, under_dir
    rows = [("/home/u/box/a", "f"), ("/home/u/box/.h/b", "f"), ("/home/u/box/sub/.h", "f"), ("/home/u/box", "d")]
    df = spark.createDataFrame(rows, "path string, kind string")
    got = sorted(r.path for r in df.filter(under_dir("/home", named("box"), skip_hidden=True)).collect())
    assert got == ["/home/u/box/a", "/home/u/box/sub/.h"]


def test_exclude_unknown_name_is_an_error(spark):
    cat = _book().catalogue(spark)
    with pytest.raises(SelectionError, match="no rule is called zz"):
        select_rules(spark, cat, exclude="b,zz")


def test_glob_classes_and_escapes(spark):
    from reclaim.functions import glob_to_regex
    rows = [("/a/f1.log",), ("/a/fx.log",), ("/a/xb",), ("/a/xa",), ("/a/q*z",), ("/a/qyz",)]
    df = spark.createDataFrame(rows, "path string")
    pick = lambda globs: sorted(r.path for r in df.filter(name_glob_any(globs)).collect())
    assert pick(["f[0-9].log"]) == ["/a/f1.log"]
    assert pick(["x[!a]"]) == ["/a/xb"]
    assert pick(["q\\*z"]) == ["/a/q*z"]
    assert glob_to_regex("*.tmp") == r"(?s)\A(?:.*\.tmp)\z"


def test_dir_contents_skip_hidden_counts(spark):
    from reclaim.operators import dir_contents, named
    rows = [("h", "/home/u/box/a", 1), ("h", "/home/u/box/.h/b", 2), ("h", "/home/u/box/s/c", 4)]
    df = spark.createDataFrame(rows, "host string, path string, size_bytes long")
    got = [(r.dir, r.files, r.bytes) for r in dir_contents(df, "/home", named("box"), skip_hidden=True).collect()]
    assert got == [("/home/u/box", 2, 5)]


def test_roots_bound_a_rule_whatever_the_number_of_rules(spark):
    from reclaim.operators import all_hits
    df = spark.createDataFrame([("/home/u/a.log",), ("/opt/a.log",)], "path string")
    logs = F.col("path").endswith(".log")
    rules = [Rule("r", logs, roots=("/home",))] + [Rule(f"n{i}", F.lit(False), roots=("/var",)) for i in range(5)]
    free = Rule("free", logs)
    for n in range(1, 6):
        assert [r.path for r in first_match(df, rules[:n]).collect()] == ["/home/u/a.log"]
        got = {r.path: r.rule for r in first_match(df, [*rules[:n], free]).collect()}
        assert got == {"/home/u/a.log": "r", "/opt/a.log": "free"}  # a rule without roots takes part on every route
        hits = [r.h for r in df.select(all_hits(rules[:n]).alias("h")).collect()]
        assert hits == [["r"], []]


def test_newlines_and_dots_in_names(spark):
    from reclaim.operators import dir_path_glob, named, under_dir
    from reclaim.plans.catalogue import file_rulebook
    rows = [(1, "/home/u/.config/my-electron-app/a\nb"), (2, "/home/u/.config/my-electron-app/.keep"),
            (3, "/home/u/.cache/x\n"), (4, "/home/u/.cache/.keep"), (5, "/home/u/Trash/.keep"), (6, "/root/.local/share/Trash/.keep"),
            (7, "/home/u/Trash/x"), (8, "/home/u/n\n/build"), (9, "/root/.thunderbird/p/Cache/.keep"), (10, "/root/.thunderbird/p/Cache/k/.x")]
    df = spark.createDataFrame([("h", i, p, "f", 1) for i, p in rows], "host string, id long, path string, kind string, size_bytes long")
    book = file_rulebook(AS_OF)
    got = {r.id: r.rule for r in first_match(df, book.rules(["cache", "electron", "thunderbird", "trash"])).collect()}
    assert got == {1: "electron", 3: "cache", 7: "trash", 10: "thunderbird"}  # one meaning of *: first-level dot entries stay
    assert [r.id for r in df.filter(under_dir("/home", dir_path_glob("*/n*"))).collect()] == [8]
    assert [r.id for r in df.filter(under_dir("/home/u/Trash", named("Trash"), skip_hidden=True)).collect()] == [7]
    assert [r.id for r in df.filter(path_glob("*/x?")).collect()] == [3]


def test_marked_directories_and_rows_without_id(spark):
    from reclaim.plans.catalogue import file_rulebook
    rows = [("h", "/home/u/p/build", "d", None), ("h", "/home/u/p/build/CMakeCache.txt", "f", 1), ("h", "/home/u/p/build/o", "d", None),
            ("h", "/home/u/q/build", "d", None), ("h", "/home/u/q/build/CMakeCache.txt", "d", None),  # the marker must be a file
            ("g", "/home/u/p/build", "d", None), ("h", "/home/u/p/build", "d", None), (None, "/home/u/p/build", "d", None)]
    df = spark.createDataFrame([(h, p, k, 1, AS_OF, i) for h, p, k, i in rows],
                               "host string, path string, kind string, size_bytes long, mtime timestamp_ntz, id long")
    got = sorted((r.host, r.path) for r in first_match(df, file_rulebook(AS_OF).rules(["cmake", "wine"])).collect())
    assert got == [("h", "/home/u/p/build")] * 2 + [("h", "/home/u/p/build/CMakeCache.txt"), ("h", "/home/u/p/build/o")]


def test_two_answers_for_one_rule_are_an_error(spark):
    cat = _book().catalogue(spark)
    sel = select_rules(spark, cat, include="a,b")
    ap = spark.createDataFrame([("a", "y"), ("a", "n")], "name string, ans string")
    with pytest.raises(Exception, match="more than one answer for a"):
        approval_gate(sel, cat, ap).collect()


def test_plan_names_survive_the_round_trip(spark, tmp_path):
    from reclaim.sources import read_plan, write_plan
    df = spark.createDataFrame([(1, "007"), (2, "7"), (3, "2024-01-01")], "id long, rule string")
    back = read_plan(spark, write_plan(df, str(tmp_path / "plan")))
    assert {(r.id, r.rule) for r in back.collect()} == {(1, "007"), (2, "7"), (3, "2024-01-01")}


def test_stored_hosts_keep_their_names(spark, tmp_path):
    from reclaim.sources import read_inventory
    df = spark.createDataFrame([("007", "/a", "f", 1, AS_OF, AS_OF, 1)], "host string, path string, kind string, "
                               "size_bytes long, mtime timestamp_ntz, atime timestamp_ntz, id long")
    df.write.partitionBy("host").parquet(str(tmp_path / "inv"))
    assert [r.host for r in read_inventory(spark, str(tmp_path / "inv")).collect()] == ["007"]


def test_empty_inputs(spark):
    from reclaim.operators import freed_between, global_row_number
    empty = spark.createDataFrame([], "id long, k string, ts timestamp_ntz, size long")
    assert over_budget(empty, "k", "ts", 10, "size").count() == 0
    assert over_budget(empty, None, "ts", 10, "size").count() == 0
    assert drop_all_but_latest(empty, "k", "ts", 3).count() == 0
    assert global_row_number(empty, [F.col("id")]).count() == 0
    readings = spark.createDataFrame([], "seq long, free long")
    assert freed_between(readings, None, "seq", "free").count() == 0
