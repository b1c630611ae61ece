"""The physical plans keep the scale properties the design relies on."""

import os
import re

import pytest

from reclaim.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


@pytest.fixture(autouse=True)
def on_a_stored_inventory(stored):
    """Root filters reach the scan where the inventory is a table."""


def plan_before(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()


def plan_of(spark, name):
    df = QUERIES[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_root_prefix_reaches_parquet(spark):
    p = plan_of(spark, "scan_roots")
    assert re.search(r"PushedFilters: \[.*StringStartsWith\(path,/home/u1/\)", p)


def test_rules_are_one_scan_no_join(spark):
    p = plan_of(spark, "first_match")
    assert "Join" not in p and "Exchange" not in p
    assert p.count("FileScan") == 1


def test_per_rule_aggregate_is_partial(spark):
    p = plan_of(spark, "reclaim_by_rule")
    assert "partial_count" in p and "Join" not in p


@pytest.mark.parametrize("name", ["user_logs", "first_match", "rule_overlap", "custom_rule", "reclaim_rollup"])
def test_rules_prune_by_their_roots(spark, name):
    assert re.search(r"PushedFilters: \[[^]]*StringStartsWith\(path,/home/\)", plan_of(spark, name)), name


def test_budget_windows_are_over_bins_and_the_edge(spark):
    p = plan_before(spark, "size_budget")
    windows = [x for x in p.splitlines() if re.search(r"[-+ ]Window \[", x)]
    # over sums by coarse bin, fine bin and value; of single rows one, over those of the edge
    assert len(windows) <= 6 and sum("_bw" not in x for x in windows) == 1


def test_global_budget_is_one_scalar(spark):
    df = QUERIES["size_budget_global"](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p and "Cartesian" not in p
    # the filter names the cut several times; it is computed once
    assert len(set(re.findall(r"(?<!Reused)Subquery (subquery#\d+)", p))) == 1


def test_keep_newest_limits_every_group_in_the_map_tasks(spark):
    p = plan_before(spark, "drop_all_but_latest")
    assert "WindowGroupLimit" in p and "Partial" in p and p.count("FileScan") == 2


def test_global_keep_n_is_a_top_n(spark):
    p = QUERIES["global_drop_last_n"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in p and "Window" not in p and "NestedLoop" not in p


def test_dir_contents_has_no_join(spark):
    p = plan_of(spark, "dir_contents")
    assert "Join" not in p and "Generate explode" in p and "partial_count" in p


def test_capped_share_has_no_window(spark):
    p = plan_of(spark, "capped_share")
    assert "Window" not in p


def test_catalogue_run_has_no_pair_joins(spark):
    # every rule in one projection: no rules x files pairing; the pass-through branch of the
    # directory flags reads no `id` (only candidate rows are joined back on it)
    p = plan_of(spark, "catalogue_run")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert any("size_bytes" in s and "id:" not in s for s in schemas)


@pytest.mark.parametrize("name", ["catalogue_run", "catalogue_run_system"])
def test_catalogue_scans_are_bounded(spark, name):
    # pass-through rows, candidate rows, their directories, marker files, old directories
    assert plan_before(spark, name).count("FileScan") <= 5
