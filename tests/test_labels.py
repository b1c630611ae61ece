"""Directory labels against the form that looks at every ancestor of every row."""

import random

import pytest
from pyspark.sql import functions as F

from reclaim.operators import dir_name_glob, named, under_dir
from reclaim.operators import labels
from reclaim.operators.tree import DirTest, dir_path_glob


@pytest.fixture(scope="module")
def tree(spark):
    rng = random.Random(5)
    rows = set()
    for _ in range(500):
        depth = rng.randint(1, 7)
        parts = [rng.choice(["a", "ab", "a-b", "a.b", ".a", "b", "wine", ".wine1", "é", "a b"]) for _ in range(depth)]
        rows.add((rng.choice(["h0", "h1", None]), "/" + "/".join(parts), rng.choice("ffd")))
    rows |= {("h0", "/home", "d"), ("h0", "/f", "f"), ("h0", "/home/a", "d"), ("h0", "/home/a/x", "f"), ("h0", "/home/a/.x", "f"),
             ("h0", "/home/a/.x/y", "f"), ("h0", "/home/a/n/a/.z/q", "f"), ("h0", "/home/a2", "f"), ("h0", "/home/a\u0002", "f")}
    data = [(h, p, k, i) for i, (h, p, k) in enumerate(sorted(rows, key=str))]
    return spark.createDataFrame(data, "host string, path string, kind string, id long").cache()


TESTS = [named("a"), named("wine", "b"), dir_name_glob(".wine*", "a?b"), dir_name_glob("*"), dir_path_glob("*/a/b*"), dir_path_glob("/home/a"),
         DirTest(fn=lambda d, n: F.length(n) == 2), dir_name_glob("none")]


@pytest.mark.parametrize("bucket", [4, 1 << 16])
def test_labels_equal_the_ancestor_form(spark, tree, bucket, monkeypatch):
    monkeypatch.setattr(labels, "BUCKET", bucket)
    dirs = labels.DirTree.of(tree)
    for i, test in enumerate(TESTS):
        root = ["/", "/home", "/a"][i % 3]
        for contents_only, skip_hidden in [(True, False), (True, True), (False, False)]:
            if root == "/" and test.names is not None:
                root = "/a"
            want = sorted(r.id for r in tree.filter(under_dir(root, test, contents_only, skip_hidden)).collect())
            got = sorted(r.id for r in dirs.under(tree, root, test, contents_only, skip_hidden).collect())
            assert got == want, (i, root, contents_only, skip_hidden, [r.path for r in tree.collect() if r.id in set(got) ^ set(want)][:9])


def test_labels_are_intervals(spark, tree):
    rows = labels.DirTree.of(tree).dirs.collect()
    assert sorted(r.pre for r in rows) == list(range(1, len(rows) + 1))
    for a in rows:
        for b in rows:
            below = a.host == b.host and (a.dir == b.dir or a.dir.startswith(b.dir + "/"))
            assert below == (b.pre <= a.pre <= b.last)


def test_no_directories(spark, tree):
    empty = tree.filter("false")
    assert labels.DirTree.of(empty).under(empty, "/home", named("a")).count() == 0
