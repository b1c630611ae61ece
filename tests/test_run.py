"""The whole-run API and the command line."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from reclaim.operators import Rule, RuleBook
from reclaim.plans.queries import AS_OF, q_select_include, six_rules
from reclaim.plans.run import run
from reclaim.sources.tables import load_inventory

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def test_journal_first_match_runs_over_the_whole_inventory(spark, monkeypatch):
    from reclaim.plans import queries
    given = []
    monkeypatch.setattr(sys.modules["reclaim.plans.run"], "run", lambda s, inv, *a, **k: given.append(inv) or run(s, inv, *a, **k))
    items = queries.q_journal_first_match(spark, SF)
    assert given[0].count() == load_inventory(spark, SF).count() > 0
    assert {r.rule for r in items.select("rule").distinct().collect()} <= {"journal", "logs"}


def test_run_matches_select_include(spark):
    inv = load_inventory(spark, SF)
    res = run(spark, inv, six_rules(), include="user_logs,cache,user_logs,trash",
              approvals=[("user_logs", "y"), ("cache", "y"), ("trash", "y")])
    got = {(r.seq, r.name, r.files, r.bytes) for r in res.report.collect()}
    want = {(r.seq, r.name, r.files, r.bytes) for r in q_select_include(spark, SF).collect()}
    assert got == want
    dup = [r for r in res.report.collect() if r.seq == 3][0]
    assert dup.bytes == 0  # a name run twice finds its rows gone
    tot = res.total.collect()[0]
    assert tot.files == sum(x[2] for x in got) and tot.bytes == sum(x[3] for x in got)
    assert res.plan.filter(F.col("rule").isNull()).count() == 0
    shares = sorted(r.bytes_share for r in res.report.collect())
    assert shares[-1] == 1.0 and shares[0] == 0.0  # the largest step against the run maximum
    capped = run(spark, inv, six_rules(), include="cache", approvals=[("cache", "y")], start_free_bytes=2)
    assert capped.report.collect()[0].bytes_share > 1  # not clamped, as the reference


def test_run_tool_gate_per_host(spark):
    inv = load_inventory(spark, SF)
    book = RuleBook([Rule("vdi", F.col("path").endswith(".vdi"), required_tools=("vboxmanage",))])
    ht = spark.createDataFrame([("h0", "vboxmanage")], "host string, tool string")
    res = run(spark, inv, book, all_rules=True, host_tools=ht)
    hosts = {r.host for r in res.plan.select("host").distinct().collect()}
    assert hosts == {"h0"}


def test_cli(spark, stored, capsys):
    from reclaim.__main__ import main
    path = stored
    assert main(["--inventory", path, "-i", "cache,trash", "--approve-all", "--as-of", AS_OF.isoformat()]) == 0
    out = capsys.readouterr().out
    assert "cache" in out and "trash" in out
    assert main(["--inventory", path, "-i", "nope", "--approve-all"]) == 1
    assert main(["--inventory", path]) == 1


def test_run_protects_snap_and_reports_durations(spark):
    rows = [("h", "/snap/core/x.log", "f", 5, 1), ("h", "/home/u/a.log", "f", 7, 2)]
    inv = spark.createDataFrame(rows, "host string, path string, kind string, size_bytes long, id long")
    book = RuleBook([Rule("logs", F.col("path").endswith(".log"))])
    t = spark.createDataFrame([(1, 2.5)], "seq long, duration_s double")
    res = run(spark, inv, book, all_rules=True, timings=t)
    assert [r.id for r in res.plan.collect()] == [2]
    rep = res.report.collect()[0]
    assert (rep.bytes, rep.duration_s, rep.duration_share) == (7, 2.5, 1.0)


def test_run_all_rules_matches_catalogue_run(spark):
    from reclaim.plans.catalogue import file_rulebook
    from reclaim.plans.queries import q_catalogue_run
    book = file_rulebook(AS_OF)
    res = run(spark, load_inventory(spark, SF), book, all_rules=True, approvals=[(n, "y") for n in book.names()])
    got = {(r.name, r.files, r.bytes) for r in res.report.collect() if r.files}
    want = {(r.rule, r.files, r.bytes) for r in q_catalogue_run(spark, SF).collect() if r.rule != "Total"}
    assert got == want and got


def test_cli_exclude_with_answers(spark, stored, capsys):
    from reclaim.__main__ import main
    path = stored
    rc = main(["--inventory", path, "-x", "home,python", "--approve", "cache=y", "--approve", "trash=n",
               "--as-of", AS_OF.isoformat()])
    out = capsys.readouterr().out
    assert rc == 0
    lines = {ln.split("|")[2].strip(): ln.split("|")[3].strip() for ln in out.splitlines() if ln.count("|") >= 5}
    assert lines["cache"] == "Success" and lines["trash"] == "Skipped" and lines["user_logs"] == "Skipped"
    assert "home" not in lines and "python" not in lines


def inventory(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, kind string, size_bytes long, id long")


ONE = [("h0", "/home/u/.cache/a", "f", 10, 1)]


def test_tools_are_never_cut(spark):
    """20 rules whose tools are all present, among 20,000 tools."""
    book = RuleBook([Rule(f"r{i:02d}", F.col("id") == i, required_tools=(f"tool{19_999 - i}",)) for i in range(20)])
    ht = spark.range(20_000).selectExpr("'h0' AS host", "concat('tool', id) AS tool")
    inv = inventory(spark, [("h0", f"/f{i}", "f", 1, i) for i in range(20)])
    rep = run(spark, inv, book, all_rules=True, host_tools=ht).report.collect()
    assert [(r.status, r.bytes) for r in rep] == [("Success", 1)] * 20


def test_answers_never_multiply_the_report(spark):
    from reclaim.operators import SelectionError
    for given in ([("cache", "n"), ("cache", "y")], [("cache", "y"), ("cache", "Y")]):
        with pytest.raises(SelectionError):
            run(spark, inventory(spark, ONE), six_rules(), include="cache", approvals=given)
    with pytest.raises(SelectionError):
        run(spark, inventory(spark, ONE), six_rules(), include="cache", errors=[("cache", "a"), ("cache", "b")])


def test_consent_is_asked_at_every_step(spark):
    def status(approvals):
        rep = run(spark, inventory(spark, ONE), six_rules(), include="cache,python,cache", approvals=approvals).report.collect()
        return [(r.status, r.bytes) for r in rep if r.name == "cache"]
    assert status([("cache", "y")]) == [("Success", 10), ("Success", 0)]
    assert status([("cache", "n"), ("cache", "y")]) == [("Skipped", 0), ("Success", 10)]  # the second step finds it
    assert status([(3, "y")]) == [("Skipped", 0), ("Success", 10)]
    assert status([]) == [("Skipped", 0)] * 2


def test_run_builds_no_job_for_its_decisions(spark):
    inv = inventory(spark, ONE)
    spark.sparkContext.setJobGroup("run", "decisions")
    try:
        run(spark, inv, six_rules(), include="cache", approvals=[("cache", "y")])
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("run")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rules_over_listings_run_with_the_others(spark):
    from reclaim.plans.catalogue import rulebook
    book = rulebook(AS_OF)
    assert len(book) == 50
    t = AS_OF.replace(day=1)
    inputs = {
        "log": spark.createDataFrame([("a", 1, AS_OF, 200 << 20), ("a", 2, t, 1), ("b", 3, t, 5)], "host string, id long, ts timestamp_ntz, size_bytes long"),
        "snaps": spark.createDataFrame([("a", "core 1 10 x disabled"), ("b", "core 1 11 x -")], "host string, line string"),
        "packages": spark.createDataFrame([(h, f"ii linux-image-{v}") for h in "ab" for v in ("1.9", "1.10")], "host string, line string"),
        "running": spark.createDataFrame([("a", "1.10"), ("b", "1.9")], "host string, current string"),
    }
    inv = inventory(spark, [("a", "/var/lib/snapd/cache/x", "f", 7, 1)]).withColumn("mtime", F.lit(t)).withColumn("atime", F.lit(t))
    res = run(spark, inv, book, include="kernels,journal,snap,logs,conda", approvals=[(n, "y") for n in book.names()], inputs=inputs)
    got = {(r.rule, r.host, r.item) for r in res.items.collect()}
    # the running kernel is each host's own; every log entry goes to one rule
    assert got == {("kernels", "a", "linux-image-1.9"), ("journal", "a", "1"), ("journal", "a", "2"), ("logs", "b", "3"),
                   ("snap", "a", "core 10")}
    rep = {r.name: r for r in res.report.collect()}
    assert (rep["snap"].files, rep["snap"].bytes) == (2, 7) and rep["conda"].missing_inputs == ["envs"] and rep["logs"].bytes == 5
    tools = spark.createDataFrame([("b", "snap")], "host string, tool string")
    res = run(spark, inv, book, include="snap", inputs=inputs, host_tools=tools)
    assert res.items.count() == 0 and res.plan.count() == 0


def test_images_in_use_on_another_host_only_are_unused(spark):
    from reclaim.plans import listing_rules as L
    imgs = spark.createDataFrame([("a", "i1,x"), ("b", "i1,x")], "host string, line string")
    used = spark.createDataFrame([("a", "i1")], "host string, image string")
    assert [(r.host, r.image) for r in L.lxc_images(imgs, used).collect()] == [("b", "i1")]
    cs = spark.createDataFrame([("a", "c1,i1"), ("a", "c2,i1"), ("b", "c1,i1")], "host string, line string")
    on = spark.createDataFrame([("a", "c1")], "host string, container string")
    assert sorted((r.host, r.container) for r in L.lxc_containers(cs, on).collect()) == [("a", "c2"), ("b", "c1")]


def test_cli_with_tools_timings_and_inputs(spark, stored, tmp_path, capsys):
    from reclaim.__main__ import main
    spark.createDataFrame([("h0", "docker")], "host string, tool string").write.parquet(str(tmp_path / "tools"))
    spark.createDataFrame([(1, 1.5)], "seq long, duration_s double").write.parquet(str(tmp_path / "timings"))
    for n, rows in (("items", "('h0', 'x', 2048), ('h1', 'x', 1)"), ("refs", "('h9', 'x', 0)")):
        spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, item, size_bytes)").selectExpr(
            "host", "item", "CAST(size_bytes AS BIGINT) AS size_bytes").write.parquet(str(tmp_path / n))
    rc = main(["--inventory", stored, "-i", "docker,virtualbox,docker", "--approve", "docker=y", "--approve", "docker=y",
               "--approve", "virtualbox=y", "--error", "virtualbox=no such disk", "--host-tools", str(tmp_path / "tools"),
               "--timings", str(tmp_path / "timings"), "--start-free", "100", "--input", f"docker_items={tmp_path / 'items'}",
               "--input", f"docker_refs={tmp_path / 'refs'}", "--items-out", str(tmp_path / "out"), "--as-of", AS_OF.isoformat()])
    out = capsys.readouterr().out
    assert rc == 0 and out.count("docker") == 2 and "2.0 KiB" in out and "Error" in out
    assert [(r.host, r.item) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("h0", "x")]
    assert main(["--inventory", stored, "-i", "docker", "--input", "nothing=/x"]) == 1


def test_cli_reads_text_listings_and_writes_the_report(spark, stored, tmp_path, capsys):
    from reclaim.__main__ import main
    (tmp_path / "a.txt").write_text("base 2 71 x disabled\nbase 2 72 x -\n")
    (tmp_path / "b.txt").write_text("base 2 70 x disabled\n")
    (tmp_path / "envs.json").write_text('{"envs": ["/o/base",\n "/o/train"]}')
    rc = main(["--inventory", stored, "-i", "snap,conda", "--approve-all", "--text-input", f"snaps@h0={tmp_path / 'a.txt'}",
               "--text-input", f"snaps@h1={tmp_path / 'b.txt'}", "--text-input", f"envs@h0={tmp_path / 'envs.json'}",
               "--items-out", str(tmp_path / "items"), "--report-out", str(tmp_path / "report"), "--as-of", AS_OF.isoformat()])
    assert rc == 0 and "snap" in capsys.readouterr().out
    got = {(r.rule, r.host, r.item) for r in spark.read.parquet(str(tmp_path / "items")).collect()}
    assert got == {("snap", "h0", "base 71"), ("snap", "h1", "base 70"), ("conda", "h0", "train")}
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_items_go_to_their_first_step_by_hashing(spark):
    """The step of the least number, its least size (null the least), without a sort of all rows."""
    from functools import reduce

    from pyspark.sql import DataFrame

    from reclaim.plans.run import _first_step
    kind = "seq bigint, rule string, input string, host string, item string, size_bytes bigint"
    frames = [[(2, "b", "log", "h", "x", 7), (2, "b", "log", "h", "x", 5), (2, "b", "log", None, "y", None), (2, "b", "log", "h", "z", -2 ** 63)],
              [(5, "e", "log", "h", "x", 1), (5, "e", "log", None, "y", 3), (5, "e", "log", "h", None, 4), (5, "e", "log", "h", None, None)],
              [(5, "e", "sdk", "h", "x", 9), (5, "e", "sdk", "h", "w", 2 ** 63 - 1)], [(2, "b", "log", "h", "x", 6)]]
    frames = [spark.createDataFrame(f, kind) for f in frames]
    got = _first_step(frames, (0, 1, 0, 0), {2: "b", 5: "e"})
    first = F.min(F.struct("seq", "rule", "size_bytes")).alias("first")
    want = reduce(DataFrame.unionByName, frames).groupBy("input", "host", "item").agg(first).select(
        "first.seq", "first.rule", "input", "host", "item", "first.size_bytes")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "SortAggregate" not in got._jdf.queryExecution().toString()


def test_the_code_of_all_rules_is_in_methods_that_are_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes: tests in one are interpreted row by row."""
    import re

    from reclaim.operators import first_match
    from reclaim.plans.catalogue import file_rulebook
    book = file_rulebook(AS_OF)
    rows = spark.createDataFrame([("h", "/home/u/.cache/x", "f", 1, AS_OF, AS_OF, 1)],
                                 "host string, path string, kind string, size_bytes long, mtime timestamp_ntz, atime timestamp_ntz, id long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = first_match(rows, book.rules(book.names()))
        assert [r.rule for r in hits.collect()] == ["cache"]
        text = spark._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "codegen")
        derived = first_match(load_inventory(spark, "/root/testdata/sf0.001"), book.rules(book.names()))
        text += spark._jvm.PythonSQLUtils.explainString(derived._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000
