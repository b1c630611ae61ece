"""The index of many rules against their expressions, and names that prune the scan."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from reclaim.operators import Rule, RuleBook, first_match, reclaim_by_rule
from reclaim.operators.rule_index import Where
from reclaim.operators.tree import marked_dirs
from reclaim.plans.run import run

T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = []
    for i in range(1500):
        path = "/" + "/".join(rng.choice(["home", "a", "b", "u1", "u2", "x.log"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", ".log", ".iso", "/f", "/.log"])
        out.append(("h", path, rng.choice("fd"), rng.choice([None, rng.randrange(100)]), T + dt.timedelta(days=rng.randrange(9)), None, i))
    return spark.createDataFrame(out, "host string, path string, kind string, size_bytes long, mtime timestamp_ntz, atime timestamp_ntz, id long").cache()


def many(n, seed=2):
    rng = random.Random(seed)
    book = RuleBook()
    for i in range(n):
        root = "/" + "/".join(rng.choice(["home", "a", "b", "u1", "u2"]) for _ in range(rng.randint(0, 3)))
        book.register_where(f"r{i:04d}", root, rng.choice(["", ".log", ".iso", "g", "x.log"]), rng.choice([None, "f", "d"]),
                            rng.choice([None, rng.randrange(100)]), rng.choice([None, T + dt.timedelta(days=rng.randrange(9))]))
    return book


def test_index_equals_the_expressions(spark, rows):
    book = many(90)
    book.register("mine", F.col("id") % 7 == 0)  # an expression among them, in run order
    names = random.Random(1).sample(book.names(), 91)
    got = {r.id: r.rule for r in first_match(rows, book.rules(names)).collect()}
    one_by_one = RuleBook([Rule(r.name, r.test) for r in book.rules(names)])
    want = {r.id: r.rule for r in first_match(rows, one_by_one.rules(names)).collect()}
    assert got == want and "mine" in got.values() and len(set(got.values())) > 20


def test_thousands_of_rules_are_few_lookups(spark, rows):
    book = many(5000, seed=4)
    hits = first_match(rows, book.rules(book.names()))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 4 * 5 and "Exchange hash" not in plan and "NestedLoop" not in plan
    first = {}
    order = sorted(book.names())
    for r in rows.collect():
        for n in order:
            w = book[n].where
            root = w.root.rstrip("/")
            if ((r.path == root or r.path.startswith(root + "/")) and r.path.endswith(w.suffix) and w.kind in (None, r.kind)
                    and (w.size_over is None or (r.size_bytes is not None and r.size_bytes > w.size_over))
                    and (w.not_after is None or r.mtime <= w.not_after)):
                first[r.id] = n
                break
    assert {r.id: r.rule for r in hits.collect()} == first


def test_a_run_of_rules_that_are_data(spark, rows):
    book = many(80, seed=6)
    book.register_where("tooled", "/home", "", required_tools=("t",))
    tools = spark.createDataFrame([("h", "other")], "host string, tool string")
    res = run(spark, rows, book, all_rules=True, host_tools=tools)
    rep = {r.name: r for r in res.report.collect()}
    assert rep["tooled"].status == "Not installed" and rep["tooled"].files == 0
    plain = {r.rule: (r.files, r.bytes) for r in reclaim_by_rule(first_match(rows, [r for r in book.rules(book.names()) if r.name != "tooled"])).collect()}
    assert {n: (r.files, r.bytes) for n, r in rep.items() if r.files} == plain
    with pytest.raises(ValueError):
        Where("/a", "b/c")


# ------------------------------------------------------------- names that prune
def test_marker_names_reach_the_scan_and_prune_it(spark, tmp_path):
    """Twenty hosts, of which one holds the marker: its name is looked up in the
    files' bloom filters, the end of a path is not."""
    from reclaim.sources.tables import INVENTORY_COLUMNS, read_inventory, write_inventory
    rows = spark.range(20_000).select(
        F.concat(F.lit("h"), (F.col("id") % 20).cast("string")).alias("host"),
        F.when(F.col("id") == 7, "/home/u/p/build/CMakeCache.txt").otherwise(F.concat(F.lit("/home/u/p"), F.col("id").cast("string"), F.lit("/build/f"),
                                                                                   F.md5(F.col("id").cast("string")))).alias("path"),
        F.lit("f").alias("kind"), F.col("id").alias("size_bytes"), F.lit(T).cast("timestamp_ntz").alias("mtime"), F.lit(T).cast("timestamp_ntz").alias("atime"), "id")
    path = write_inventory(rows, str(tmp_path / "inv"))
    plain, named = read_inventory(spark, path), read_inventory(spark, path, names=True)
    assert plain.columns == INVENTORY_COLUMNS and named.columns == [*INVENTORY_COLUMNS, "dir", "name"]

    def scanned(df):
        marks = marked_dirs(df, "build", "CMakeCache.txt")
        assert [tuple(r) for r in marks.collect()] == [("h7", "/home/u/p/build")]
        plan = marks._jdf.queryExecution().executedPlan()

        def scan(node):
            if node.nodeName().startswith("Scan parquet"):
                return node.metrics().apply("numOutputRows").value()
            if hasattr(node, "executedPlan") and "Adaptive" in node.nodeName():
                return scan(node.executedPlan())
            below = [scan(node.plan())] if "QueryStage" in node.nodeName() else [scan(node.children().apply(i)) for i in range(node.children().size())]
            return max(below, default=0)
        return scan(plan), plan.toString()

    n_plain, _ = scanned(plain)
    n_named, text = scanned(named)
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(name,CMakeCache.txt\)", text)
    assert n_plain == 20_000 and n_named <= 2_000
