"""Listing rules on small hand-made inputs."""

import datetime as dt

from pyspark.sql import functions as F

from reclaim.plans import listing_rules as L

AS_OF = dt.datetime(2024, 1, 31)


def test_kernels_before_the_running_one_of_each_host(spark):
    pk = ["linux-image-6.1.0-9-cloud", "linux-image-6.1.0-17-cloud", "linux-image-6.1.0-23-cloud"]
    lines = [(h, f"ii  {p}  1  arm64  kernel") for p in pk for h in "xyz"] + [("x", "ii  less  590  arm64  pager")]
    df = spark.createDataFrame(lines, "host string, line string")
    running = spark.createDataFrame([("x", "6.1.0-23-cloud"), ("y", "6.1.0-17-cloud"), ("z", "5.0.0-1-none"), ("w", "x")],
                                    "host string, current string")
    got = sorted((r.host, r.package) for r in L.kernels(df, running).collect())
    assert got == sorted([("x", pk[0]), ("x", pk[1]), ("y", pk[0])])
    assert L.kernels(df, running.limit(0)).count() == 0


def test_apt_packages(spark):
    # the two names are fixed values that must equal the reference's
    df = spark.createDataFrame([("h", "nano"), ("h", "vim-tiny"), ("h", "tmux")], "host string, package string")
    assert sorted(r.package for r in L.apt_packages(df).collect()) == ["nano", "vim-tiny"]


def test_android_and_conda(spark):
    sdk = spark.createDataFrame([("h", "system-images;watch-9;plain;arm | 4.1 | Installed"), ("g", "  emulator-canary | 31.2"),
                                 ("h", "platform-tools | 35")], "host string, line string")
    assert sorted((r.host, r.package) for r in L.android_packages(sdk).collect()) == \
        [("g", "emulator-canary"), ("h", "system-images;watch-9;plain;arm")]
    docs = spark.createDataFrame([("h", '{"envs": ["/o/base", "/o/e/train", "/o/e/eval"]}'), ("h", '{"envs": []}')],
                                 "host string, doc string")
    assert [r.env for r in L.conda_envs(docs).collect()] == ["train", "eval"]


def test_timeshift_keeps_three(spark):
    lines = [("h", f"  {i}  >  2024-01-0{i}_10-00-00  O  x") for i in range(1, 6)]
    df = spark.createDataFrame(lines, "host string, line string")
    got = sorted(r.stamp for r in L.timeshift_snapshots(df).collect())
    assert got == ["2024-01-01_10-00-00", "2024-01-02_10-00-00"]


def test_journal_and_binlogs(spark):
    t = AS_OF
    rows = [(1, "h", t - dt.timedelta(days=4), 10), (2, "h", t - dt.timedelta(hours=1), 200 * 1024 * 1024),
            (3, "h", t - dt.timedelta(days=8, hours=1), 1)]
    df = spark.createDataFrame(rows, "id long, host string, ts timestamp_ntz, size_bytes long")
    got = sorted((r.rule, r.id) for r in L.journal(df, AS_OF).collect())
    assert got == [("journal", 1), ("journal", 2), ("journal", 3)]  # each entry once: journal runs before logs
    small = df.withColumn("size_bytes", F.lit(1).cast("long"))
    assert sorted((r.rule, r.id) for r in L.journal(small, AS_OF).collect()) == [("logs", 1), ("logs", 3)]
    assert sorted(r.id for r in L.old_logs(df, AS_OF).collect()) == [1, 3]
    assert sorted(r.id for r in L.journal_excess(df).collect()) == [1, 2, 3]
    assert [r.id for r in L.binlogs(df, AS_OF).collect()] == [3]


def test_lxc_and_gems(spark):
    imgs = spark.createDataFrame([("h", "a1,alpine,x"), ("h", "b2,debian,y")], "host string, line string")
    used = spark.createDataFrame([("h", "b2")], "host string, image string")
    assert [r.image for r in L.lxc_images(imgs, used).collect()] == ["a1"]
    gems = spark.createDataFrame([("h", 1, "plum", "3.0.1"), ("h", 2, "plum", "3.0.10"), ("h", 3, "pear", "2.1"), ("g", 4, "plum", "1")],
                                 "host string, id long, gem string, version string")
    assert [r.version for r in L.old_gems(gems).collect()] == ["3.0.1"]


def test_equal_snapshot_stamps_count_once(spark):
    lines = [("h", f"  {i}  >  2024-01-0{d}_10-00-00  O  x") for i, d in enumerate((1, 2, 3, 3, 4))]
    df = spark.createDataFrame(lines, "host string, line string")
    assert [r.stamp for r in L.timeshift_snapshots(df).collect()] == ["2024-01-01_10-00-00"]


def test_read_listing_files(spark, tmp_path):
    from reclaim.sources import read_documents, read_lines
    (tmp_path / "snap.txt").write_text("Name  Version  Rev  Notes\nbase  2  71  disabled\nbase  2  72  -\n")
    (tmp_path / "envs.json").write_text('{"envs": ["/o/base",\n "/o/e/train"]}')
    lines = read_lines(spark, str(tmp_path / "snap.txt")).withColumn("host", F.lit("h"))
    assert [(r.snap, r.revision) for r in L.snap_revisions(lines).collect()] == [("base", "71")]
    docs = read_documents(spark, str(tmp_path / "envs.json")).withColumn("host", F.lit("h"))
    assert [r.env for r in L.conda_envs(docs).collect()] == ["train"]


def test_each_artifact_rule_has_tasks_of_its_own(spark, tmp_path):
    """Five joins over the same inputs are not run one after the other in each task."""
    from reclaim.plans.queries import q_unused_artifacts
    spark.createDataFrame([(n,) for n in range(40)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(n, "P" if n % 2 else "O") for n in range(30)] + [(None, "P")], "o_custkey long, o_orderstatus string") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = q_unused_artifacts(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() == 4 * len(L.ARTIFACT_RULES)
        unused = [f"a{n}" for n in range(40) if n % 2 == 0 or n >= 30]
        assert sorted((r.rule, r.item) for r in df.collect()) == sorted((r, i) for r in L.ARTIFACT_RULES for i in unused)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
