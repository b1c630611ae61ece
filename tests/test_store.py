"""Plans in versions, runs that read the inventory once, tools, texts that do
not parse, version order, steps in order."""

import os
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from reclaim.functions import format_bytes, version_key
from reclaim.operators import Rule, RuleBook, superseded, union_step_frames
from reclaim.operators.selection import ToolBits, applicable_rules
from reclaim.plans.queries import QUERIES, six_rules
from reclaim.plans.run import run
from reclaim.sources.listings import fields_reason, json_reason, quarantine, regex_reason
from reclaim.sources.sinks import plan_versions, read_plan, write_plan

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------- versions
def ids(spark, path):
    return sorted(r.id for r in read_plan(spark, path).collect())


def test_a_write_that_fails_leaves_the_plan_before(spark, tmp_path):
    path = str(tmp_path / "plan")
    with pytest.raises(FileNotFoundError):
        read_plan(spark, path)
    write_plan(spark.range(100).withColumn("rule", F.lit("a")), path)
    stops = F.when(F.col("id") == 977, F.raise_error(F.lit("the writer was killed"))).otherwise(F.lit("b"))
    with pytest.raises(Exception, match="the writer was killed"):
        write_plan(spark.range(0, 1000, 1, 8).withColumn("rule", stops), path)
    assert ids(spark, path) == list(range(100))
    # files of the dead write, even whole ones, are no version
    spark.range(5).withColumn("rule", F.lit("c")).write.partitionBy("rule").parquet(f"{path}/version=00000009-dead")
    assert ids(spark, path) == list(range(100))
    write_plan(spark.range(7).withColumn("rule", F.lit("b")), path)
    assert ids(spark, path) == list(range(7))


def test_a_write_killed_before_its_switch_is_not_read(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    path = str(tmp_path / "plan")
    write_plan(spark.range(3).withColumn("rule", F.lit("a")), path)
    # all files are there, the manifest is not
    monkeypatch.setattr(DataFrame, "coalesce", lambda self, n: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        write_plan(spark.range(50).withColumn("rule", F.lit("a")), path)
    monkeypatch.undo()
    assert ids(spark, path) == [0, 1, 2] and len([x for x in os.listdir(path) if x.startswith("version=")]) == 2


def test_older_versions_go_after_the_switch(spark, tmp_path):
    path = str(tmp_path / "plan")
    for n in range(1, 5):
        write_plan(spark.range(n).withColumn("rule", F.lit("007")), path)
    kept = plan_versions(spark, path)
    assert [m["number"] for m in kept] == [3, 4]
    assert sorted(x for x in os.listdir(path) if x.startswith("version=")) == [m["version"] for m in kept]
    assert {r.rule for r in read_plan(spark, path).collect()} == {"007"} and ids(spark, path) == [0, 1, 2, 3]
    write_plan(spark.range(0).withColumn("rule", F.lit("x")), path)  # an empty plan is one too
    assert read_plan(spark, path).columns == ["id", "rule"] and ids(spark, path) == []


# ------------------------------------------------------------------- one read
def counted(spark, inventory):
    """The inventory, and how many of its rows have been read."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf
    return inventory.mapInPandas(through, inventory.schema), read


def files(spark, n=200):
    return spark.range(n).select(F.lit("h0").alias("host"), F.concat(
        F.lit("/home/u/"), F.element_at(F.array(*map(F.lit, [".cache/a", "x.log", "keep", ".local/share/Trash/f"])), (F.col("id") % 4 + 1).cast("int")),
        F.col("id").cast("string")).alias("path"), F.lit("f").alias("kind"), (F.col("id") + 1).alias("size_bytes"),
        F.lit(None).cast("timestamp_ntz").alias("mtime"), F.lit(None).cast("timestamp_ntz").alias("atime"), "id")


def test_plan_and_report_read_the_inventory_once(spark, tmp_path):
    inventory, read = counted(spark, files(spark))
    book = six_rules()
    res = run(spark, inventory, book, include="cache,trash", approvals=[(n, "y") for n in book.names()])
    stored = res.store(str(tmp_path / "run"))
    report, total = stored.report.collect(), stored.total.first()
    assert stored.plan.count() == total.files == sum(r.files for r in report) == 100
    assert read.value == 200
    # the same as worked out from the inventory
    plain = [r.asDict() for r in res.report.collect()]
    assert plain == [r.asDict() for r in report] and read.value > 200
    assert spark.read.json(str(tmp_path / "run" / "report")).count() == 2


def test_a_stored_run_measures_its_steps(spark, tmp_path):
    """Listing steps each by itself, the steps over the inventory together; rows
    and bytes as without."""
    from reclaim.plans.catalogue import rulebook
    from reclaim.plans.queries import AS_OF, run_inputs
    book = rulebook(AS_OF)
    inventory, read = counted(spark, files(spark))
    res = run(spark, inventory, book, include="cache,journal,logs,snap,conda,trash", approvals=[(n, "y") for n in book.names() if n != "trash"],
              inputs=run_inputs(spark, SF))
    stored = res.store(str(tmp_path / "run"), measure=True)
    report = {r.name: r for r in stored.report.collect()}
    assert read.value == 200
    assert all(report[n].duration_s > 0 for n in ("cache", "journal", "logs", "snap", "conda")) and report["trash"].duration_s == 0
    assert max(r.duration_share for r in report.values()) == 1
    plain = {r.name: (r.files, r.bytes, r.status) for r in res.report.collect()}
    assert plain == {n: (r.files, r.bytes, r.status) for n, r in report.items()}
    assert sorted(map(tuple, stored.items.select("seq", "rule", "input", "host", "item", "size_bytes").collect())) == sorted(
        map(tuple, res.items.select("seq", "rule", "input", "host", "item", "size_bytes").collect()))


def test_cli_reads_the_inventory_once_where_the_plan_is_written(spark, tmp_path, capsys, monkeypatch):
    import reclaim.sources.tables as tables
    from reclaim.__main__ import main
    inventory, read = counted(spark, files(spark))
    monkeypatch.setattr(tables, "read_inventory", lambda *_: inventory)
    assert main(["--inventory", "x", "-i", "cache,trash", "--approve-all", "--run-out", str(tmp_path / "run"),
                 "--as-of", "2024-01-31T00:00:00"]) == 0
    out = capsys.readouterr().out
    assert read.value == 200 and "cache" in out and "Success" in out
    assert read_plan(spark, str(tmp_path / "run" / "plan")).count() == 100


# ---------------------------------------------------------------------- tools
def test_tool_bits_over_many_words(spark):
    tools = [f"t{i:03d}" for i in range(200)]
    has = {f"h{h}": set(random.Random(h).sample(tools, 5)) for h in range(30)} | {"none": set()}
    rows = [(h, t) for h, own in has.items() for t in own] * 2 + [("none", "of another kind"), ("none", None)]
    bits = ToolBits(tools)
    hosts = bits.hosts(spark.createDataFrame(rows, "host string, tool string"))
    sets = [[()], [("t000",)], [("t001", "t150")], [("t199",), ("t070",)], [tuple(tools)], []]
    got = applicable_rules(sets, hosts, bits)
    for parts, (able, not_able) in zip(sets, got):
        want = sum(not parts or any(not p or own & set(p) for p in parts) for own in has.values())
        assert (able, not_able) == (want, len(has) - want)
    assert applicable_rules([[("a",)]], ToolBits(["a"]).hosts(spark.createDataFrame([], "host string, tool string")), ToolBits(["a"])) == [(0, 0)]


def test_a_rule_without_its_tool_is_not_a_success(spark):
    book = RuleBook([Rule("wine", F.col("id") == 1, required_tools=("wine",)), Rule("all", F.col("id") == 2),
                     Rule("asked", F.col("id") == 3, requires_approval=True, required_tools=("wine",))])
    tools = spark.createDataFrame([("h0", "docker"), ("h1", "snap")], "host string, tool string")
    rep = {r.name: r for r in run(spark, files(spark, 9), book, all_rules=True, host_tools=tools).report.collect()}
    assert (rep["wine"].status, rep["wine"].message, rep["wine"].files) == ("Not installed", "Skipped (not installed)", 0)
    assert (rep["wine"].hosts_applicable, rep["wine"].hosts_not_applicable) == (0, 2)
    assert rep["all"].status == "Success" and rep["all"].files == 1 and rep["all"].hosts_applicable == 2
    assert rep["asked"].status == "Skipped"  # not asked for comes first
    plain = run(spark, files(spark, 9), book, all_rules=True).report.collect()
    assert {r.status for r in plain if r.name != "asked"} == {"Success"} and plain[0].hosts_applicable is None


# -------------------------------------------------------- texts that do not parse
def test_quarantine_adds_up(spark):
    docs = ['{"envs": ["/a/b"]}', '{"envs": []}', '{"envs": ["/a/b"', '{"env": 1}', "[]", "", "  ", None, "text", '{"envs": 5}', '{"envs": null}', "7"]
    df = spark.createDataFrame([("h", d) for d in docs], "host string, doc string")
    good, bad = quarantine(df, "doc", json_reason("doc"))
    assert {r.doc for r in good.collect()} == set(docs[:2])
    reasons = {r.doc: r.reason for r in bad.collect()}
    assert good.count() + bad.count() == len(docs)
    assert reasons['{"envs": ["/a/b"'] == reasons["text"] == "not JSON" and reasons[""] == reasons[None] == "no text" and reasons['{"env": 1}'] == "no envs"
    lines = spark.createDataFrame([("a b c",), ("  a   b ",), ("a",), (None,), ("a,b,c",)], "line string")
    assert [r[0] for r in lines.select(fields_reason("line", 3)).collect()] == [None, "2 of 3 fields", "1 of 3 fields", "no text", "1 of 3 fields"]
    assert [r[0] for r in lines.select(fields_reason("line", 2, ",")).collect()][-1] is None
    assert [r[0] for r in lines.select(regex_reason("line", r"\bb\b")).collect()] == [None, None, "no match", "no text", None]


# -------------------------------------------------------------------- version order
#: Fixed order of ``sort -V``.
VERSIONS = ["", ".", "..", ".a", ".b", "1.0~~", "1.0~", "1.0", "1.0.1", "1.0.2~rc1", "1.0.2", "1.0.10", "1.2~alpha", "1.2~rc1", "1.2~rc10",
            "1.2", "1.2a", "1.2b", "1.2+dfsg", "1.2-1", "1.2-2", "1.2-10", "1.9", "1.10", "1.10.tar.gz", "1.10.zip", "2", "10",
            "99999999999999999999998", "99999999999999999999999", "a1", "a1b", "a2", "a10", "linux-image-5.4.0-9-generic", "linux-image-5.4.0-10-generic"]


def test_versions_in_the_full_order(spark):
    shuffled = random.Random(4).sample(VERSIONS, len(VERSIONS))
    got = [r.v for r in spark.createDataFrame([(v,) for v in shuffled], "v string").orderBy(version_key("v")).collect()]
    assert got == VERSIONS


@pytest.mark.skipif(not shutil.which("sort"), reason="no sort program")
def test_versions_as_sort_orders_them(spark):
    rng = random.Random(9)
    made = {"".join(rng.choices(["0", "1", "9", "10", "007", ".", "~", "-", "+", "a", "B", "rc", "_", ".tar"], k=rng.randint(1, 7))) for _ in range(1500)}
    want = subprocess.run(["sort", "-V"], input="\n".join(made) + "\n", capture_output=True, text=True, env={"LC_ALL": "C"}, check=True).stdout.split("\n")[:-1]
    got = [r.v for r in spark.createDataFrame([(v,) for v in made], "v string").orderBy(version_key("v")).collect()]
    assert got == want


def test_superseded_by_hash_aggregates(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["1.9", "1.10", "1.10~rc1", None]), None if i % 17 == 0 else rng.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "n long, k string, v string, id long")
    got = superseded(df, "k", version_key("v"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    order = {None: 0, "1.10~rc1": 2, "1.9": 1, "1.10": 3}
    place = lambda r: (order[r[2]], -1 if r[3] is None else r[3])
    newest = {k: max(place(r) for r in rows if r[1] == k) for k in ("a", "b", None)}
    assert sorted(r.n for r in got.collect()) == [r[0] for r in rows if place(r) < newest[r[1]]]


def test_step_frames_keep_the_first_step(spark):
    steps = [spark.createDataFrame([(i, f"step {n}") for i in ids_], "id long, what string") for n, ids_ in enumerate([[5, 3], [3, 4, 5], [1, 4, 4]])]
    for _ in range(3):
        got = {r.id: r.what for r in union_step_frames(steps, "id").collect()}
        assert got == {5: "step 0", 3: "step 0", 4: "step 1", 1: "step 2"}


def test_format_bytes_over_the_whole_range(spark):
    rng = random.Random(6)
    cases = [2 ** k + d for k in range(63) for d in (-1, 0, 1)] + [rng.randrange(2 ** rng.randint(1, 63)) for _ in range(2000)] + [2 ** 63 - 1, 0, 1280, 1331]
    want = []
    for n in cases:
        e = max([k for k in range(7) if k == 0 or float(n) >= 1024.0 ** k])
        want.append(f"{n} B" if n < 1024 else f"{float(n) / 1024 ** e:.1f} {'KMGTPE'[e - 1]}iB")
    got = [r[0] for r in spark.createDataFrame([(n,) for n in cases], "bytes long").select(format_bytes("bytes")).collect()]
    assert [x for x in zip(cases, got, want) if x[1] != x[2]] == []


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_some_artifacts_are_unused_and_some_are_not(spark):
    from reclaim.plans.queries import artifact_items
    assert 0 < QUERIES["unused_artifacts"](spark, SF).count() < 5 * artifact_items(spark, SF).count()
