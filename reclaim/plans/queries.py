"""The registered queries: one per operator of SURVEY §2, each reading the
driver's tables (or the inventory Spark derives from ``events``) in full.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the oracle SQL of :mod:`reclaim.plans.oracle`.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reclaim.functions import (MIB, age_days_over, base_name, before_day_boundary, contains_any,
                               depth_is, format_bytes, format_duration, kind_in, line_matches,
                               name_glob_any, name_in, not_under, older_than, parent_dir, path_glob,
                               size_label, size_over, status_label, trim_chars, version_key)
from reclaim.functions.paths import below
from reclaim.functions.text import field
from reclaim.operators import (Rule, RuleBook, all_hits, before_current, capped_share,
                               contents_of, dir_contents, dir_name_glob, dir_path_regex, drop_all_but_latest, drop_last_n,
                               first_match, freed_between, named, ordered_catalogue,
                               over_budget, reachable, reclaim_by_rule, scan_roots,
                               superseded, tool_gate, under_dir, under_marked_dirs, union_step_frames, union_steps,
                               unknown_names, unreferenced, with_grand_total, with_host_tools)
from reclaim.operators.labels import DirTree
from reclaim.operators.order import global_row_number
from reclaim.plans.catalogue import (ELECTRON_GLOB, HOME_TEMP_GLOBS,
                                     file_rulebook)
from reclaim.plans.derived import system_inventory
from reclaim.sources import (csv_field, json_env_names, load_inventory, read_table, regex_all,
                             union_apart, with_directories, ws_field)
from reclaim.sources.listings import STAMP_FORMAT, STAMP_PATTERN
from reclaim.sources.sinks import read_plan, scratch_path, write_plan

# Fixed query parameters (FIXTURES.md): the clock, and ages shortened to fit
# the 30 days of test data.
AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
AGE_DAYS = 10
RETAIN_DAYS, DAY_BOUNDARY_DAYS = 3, 7
KEEP_N = 3
HOST_BUDGET = 100 * MIB
GLOBAL_BUDGET = 20_000_000_000
CURRENT_BRAND = "Brand#17"
CAP_SHARE = 400_000.0

Q = Callable[[SparkSession, str], DataFrame]


def inv(spark, sf, names: bool = False) -> DataFrame:
    return load_inventory(spark, sf, names)


# -- the five rules of the first-match family ---------------------------------
def five_rules() -> list[Rule]:
    """cache, electron, python, trash, user_logs -- sorted, as ``--all`` runs them."""
    book = file_rulebook(AS_OF)
    return book.rules(["cache", "electron", "python", "trash", "user_logs"])


def six_rules() -> RuleBook:
    book = file_rulebook(AS_OF)
    return RuleBook(book.rules(["cache", "electron", "home", "python", "trash", "user_logs"]))


# -- 2.1 scans, sources, sinks -------------------------------------------------
def q_scan_roots(spark, sf):
    return scan_roots(inv(spark, sf), ["/home/u1", "/home/u2"]).select("id", "host", "path", "size_bytes")


def q_listing_csv_first(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "event_type"])
    line = F.concat_ws(",", F.concat(F.lit("img"), F.col("user_id").cast("string")),
                       F.col("event_type"), F.col("event_id").cast("string"))
    return ev.select("event_id", csv_field(line, 0).alias("image"))


def _sdk_lines(spark, sf):
    p = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_brand"])
    line = F.concat(F.lit("  "), F.regexp_replace("p_name", " ", ";"), F.lit("    | "),
                    F.col("p_brand"), F.lit(" | Installed"))
    return p.select("p_partkey", line.alias("line"))


def q_listing_ws_field(spark, sf):
    lines = _sdk_lines(spark, sf)
    return (lines.filter(contains_any(["ring", "bolt"], "line"))
            .select("p_partkey", ws_field("line", 0).alias("package"), ws_field("line", 2).alias("version")))


def _env_docs(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "event_type"])
    doc = F.concat(F.lit('{"envs": ["/opt/conda/envs/base", "/opt/conda/envs/'), F.col("event_type"),
                   F.lit("_"), (F.col("user_id") % 3).cast("string"), F.lit('"]}'))
    return ev.select("event_id", doc.alias("doc"))


def q_listing_json_envs(spark, sf):
    from reclaim.functions.predicates import protect
    d = _env_docs(spark, sf)
    return (d.select("event_id", F.explode(json_env_names("doc")).alias("env"))
            .filter(protect(["base"], "env")))


def _snapshot_lines(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "ts"])
    line = F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit("  >  "),
                    F.date_format("ts", STAMP_FORMAT), F.lit("  O  user"))
    return ev.select("event_id", "user_id", line.alias("line"))


def q_listing_regex_stamps(spark, sf):
    lines = _snapshot_lines(spark, sf)
    stamps = lines.select("event_id", "user_id", F.explode(regex_all("line", STAMP_PATTERN)).alias("stamp"))
    stamps = stamps.withColumn("stamp_ts", F.to_timestamp_ntz("stamp", F.lit(STAMP_FORMAT)))
    return drop_all_but_latest(stamps, "user_id", "stamp_ts", KEEP_N, tiebreak="event_id") \
        .select("event_id", "user_id", "stamp")


def q_write_plan_roundtrip(spark, sf):
    plan = (inv(spark, sf).filter(name_glob_any(["*.log"]))
            .select("id", "path", F.lit("logs_glob").alias("rule")))
    path = scratch_path(spark, "plan")
    write_plan(plan, path)
    return read_plan(spark, path).select("id", "rule", "path")


# -- 2.2 filters ----------------------------------------------------------------
def q_filter_kind(spark, sf):
    return with_directories(inv(spark, sf)).filter(kind_in("d")).select("host", "path", "kind", "mtime")


def q_filter_name_in(spark, sf):
    return (with_directories(inv(spark, sf)).filter(name_in([".cache", "Trash", "CMakeCache.txt"]))
            .select("host", "path", "kind"))


def q_filter_name_globs(spark, sf):
    return inv(spark, sf).filter(name_glob_any(HOME_TEMP_GLOBS)).select("id", "path")


def q_filter_path_glob(spark, sf):
    return inv(spark, sf).filter(path_glob(ELECTRON_GLOB)).select("id", "path")


def q_filter_not_under(spark, sf):
    return inv(spark, sf).filter(not_under("/home/u1")).select("id", "path")


def q_filter_age_mtime(spark, sf):
    return inv(spark, sf).filter(age_days_over(AGE_DAYS, AS_OF, "mtime")).select("id", "mtime")


def q_filter_age_atime(spark, sf):
    return inv(spark, sf).filter(age_days_over(AGE_DAYS, AS_OF, "atime")).select("id", "atime")


def q_filter_size(spark, sf):
    return inv(spark, sf).filter(size_over(10, MIB)).select("id", "size_bytes")


def q_filter_depth(spark, sf):
    i = inv(spark, sf)
    return i.filter(kind_in("f") & depth_is("/home", 3)).select("id", "path")


def q_filter_contains_any(spark, sf):
    p = read_table(spark, sf, "part", ["p_partkey", "p_name"])
    return p.filter(contains_any(["ring", "bolt"], "p_name"))


def q_filter_line_matches(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    return p.filter(line_matches(r"/en/\d+", "url"))


def q_retain_by_age(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "ts"])
    return e.filter(older_than(dt.timedelta(days=RETAIN_DAYS), AS_OF, "ts"))


def q_retain_day_boundary(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "ts"])
    return e.filter(before_day_boundary(DAY_BOUNDARY_DAYS, AS_OF, "ts"))


# -- 2.3 joins ------------------------------------------------------------------
def q_rule_overlap(spark, sf):
    rules = six_rules().rules(six_rules().names())
    hits = reachable(inv(spark, sf), rules).select("id", F.explode(F.array(all_hits(rules))).alias("_hits"))
    return (hits.filter(F.size("_hits") >= 2)
            .select("id", F.size("_hits").cast("long").alias("n_rules"),
                    F.array_join("_hits", ",").alias("rules")))


def q_dir_contents(spark, sf):
    return dir_contents(inv(spark, sf), "/home", named(".cache", "Trash"), by_host=False)


def q_dir_contents_skip_hidden(spark, sf):
    i = inv(spark, sf)
    return i.filter(under_dir("/home", dir_path_regex(r"^/home/[^/]+$"), skip_hidden=True)).select("id", "path")


def q_marker_dirs(spark, sf):
    m = under_marked_dirs(inv(spark, sf, names=True), "/home", "build", "CMakeCache.txt", flag="_m")
    return m.filter("_m").select("id", "path", "size_bytes")


def q_marker_dirs_with_dirs(spark, sf):
    """C3 with directory rows: the marked directories themselves are in it."""
    m = under_marked_dirs(with_directories(inv(spark, sf)), "/home", "build", "CMakeCache.txt", flag="_m")
    return m.filter("_m").select("host", "path", "kind")


def q_unreferenced(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "source"])
    lab = read_table(spark, sf, "labels", ["doc_id"])
    return unreferenced(d, lab, "doc_id")


HOST_TOOLS = [("h0", "vboxmanage"), ("h1", "vboxmanage"), ("h1", "mariadb"), ("h2", "mysql"),
              ("h3", "docker")]


def gated_rules() -> list[Rule]:
    return [
        Rule("vbox_images", below("/home") & kind_in("f") & name_glob_any(["*.vdi"]),
             required_tools=("vboxmanage",)),
        Rule("db_logs", below("/home") & kind_in("f") & name_glob_any(["*.log"])
             & age_days_over(AGE_DAYS, AS_OF, "mtime"), required_tools=("mysql", "mariadb")),
        Rule("python", file_rulebook(AS_OF)["python"].predicate),
    ]


def q_tool_gate(spark, sf):
    """A rule acts on a host only where one of its tools is present."""
    rules = gated_rules()
    ht = spark.createDataFrame(HOST_TOOLS, "host string, tool string")
    i = with_host_tools(inv(spark, sf), ht)
    gated = [Rule(r.name, r.predicate & tool_gate(r.required_tools)) for r in rules]
    hits = first_match(i, gated)
    return reclaim_by_rule(hits, extra_keys=["host"])


APPROVAL_INCLUDE = "cache,trash,user_logs,electron,python"
APPROVALS = [("cache", "y"), ("trash", "n"), ("user_logs", "Y")]


def _run(spark, sf, include, approvals, errors=()):
    """C5 + C8 + E7 + D1 + D3 through the whole-run API."""
    from reclaim.plans.run import run
    return run(spark, inv(spark, sf), six_rules(), include=include, approvals=approvals, errors=errors)


def q_approval_gate(spark, sf):
    rep = _run(spark, sf, APPROVAL_INCLUDE, APPROVALS).report
    return rep.select("seq", "name", (F.col("status") == "Skipped").alias("skipped"), "files", "bytes")


SELECT_INCLUDE = "user_logs,cache,user_logs,trash"
SELECT_EXCLUDE = "home,python"


def q_unknown_names(spark, sf):
    """Names asked for, one per event type in order, that no rule has."""
    e = read_table(spark, sf, "events", ["event_id", "event_type"])
    asked = F.when(F.col("event_type") == "error", "cache").when(F.col("event_type") == "click", "trash").otherwise(F.col("event_type"))
    req = e.groupBy(asked.alias("name")).agg(F.min("event_id").alias("pos"))
    return unknown_names(req, six_rules().catalogue(spark)).select("pos", "name")


def q_select_include(spark, sf):
    approvals = [("user_logs", "y"), ("cache", "y"), ("trash", "y")]
    return _run(spark, sf, SELECT_INCLUDE, approvals).report.select("seq", "name", "files", "bytes")


def q_select_exclude(spark, sf):
    from reclaim.plans.run import run
    book = six_rules()
    res = run(spark, inv(spark, sf), book, exclude=SELECT_EXCLUDE, approvals=[(n, "y") for n in book.names()])
    return res.report.select("seq", "name", "files", "bytes")


# -- 2.4 aggregations -------------------------------------------------------------
def _first5(spark, sf):
    return first_match(inv(spark, sf), five_rules())


def q_reclaim_by_rule(spark, sf):
    return reclaim_by_rule(_first5(spark, sf))


def q_reclaim_rollup(spark, sf):
    return with_grand_total(_first5(spark, sf))


RUN_INCLUDE = "cache,trash,user_logs,electron"
RUN_APPROVALS = [("cache", "y"), ("trash", "n"), ("user_logs", "Y")]
RUN_ERRORS = [("electron", "permission denied")]


def q_run_report(spark, sf):
    return _run(spark, sf, RUN_INCLUDE, RUN_APPROVALS, RUN_ERRORS).report.select(
        "seq", "name", "status", "files", "bytes")


RUN_FREE = 1_000_000_000


def q_run_report_columns(spark, sf):
    """The rest of the report: texts, durations (one step a thousandth of the
    events of its position) and shares."""
    from reclaim.plans.run import run
    e = read_table(spark, sf, "events", ["event_id"])
    timings = e.groupBy((F.col("event_id") % 4 + 1).alias("seq")).agg(
        (F.count(F.lit(1)) * F.col("seq") / F.lit(1000.0)).alias("duration_s"))
    res = run(spark, inv(spark, sf), six_rules(), include=RUN_INCLUDE, approvals=RUN_APPROVALS, errors=RUN_ERRORS,
              timings=timings, start_free_bytes=RUN_FREE)
    return res.report.select("seq", "name", "message", "error", "duration_s", "max_bytes", "max_duration_s",
                             "bytes_share", "duration_share", "freed")


def q_capped_share(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    r = capped_share(o, "o_totalprice", CAP_SHARE, keys=["o_orderstatus"], max_out="max_price")
    return r.select("o_orderkey", "o_orderstatus", "max_price", "share")


# -- 2.5 windows ----------------------------------------------------------------------
def q_drop_all_but_latest(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "user_id", "ts"])
    return drop_all_but_latest(e, "user_id", "ts", KEEP_N, tiebreak="event_id")


def q_superseded(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "source", "lang"])
    return superseded(d, ["source", "lang"], version_key(F.col("doc_id").cast("string")), tiebreak="doc_id")


def _brands(spark, sf):
    return read_table(spark, sf, "part", ["p_partkey", "p_type", "p_brand"])


def q_before_current(spark, sf):
    p = _brands(spark, sf)
    return before_current(p, "p_type", version_key("p_brand"), F.col("p_brand") == CURRENT_BRAND)


def q_before_current_no_current(spark, sf):
    p = _brands(spark, sf)
    return before_current(p, "p_type", version_key("p_brand"), F.col("p_brand") == "Brand#99")


def q_size_budget(spark, sf):
    r = over_budget(inv(spark, sf), "host", "mtime", HOST_BUDGET, weight="size_bytes")
    return r.filter("drop").select("id", "host")


def q_size_budget_global(spark, sf):
    r = over_budget(inv(spark, sf), None, "mtime", GLOBAL_BUDGET, weight="size_bytes")
    return r.filter("drop").select("id")


def _by_month(spark, sf, tie: Column) -> DataFrame:
    """The inventory with the month for a time, so that few times hold all rows, and another tiebreak."""
    return inv(spark, sf).select("id", "host", "size_bytes", F.date_trunc("MONTH", "mtime").alias("month"), tie.alias("tie"))


def _digest(c) -> Column:
    return F.md5(F.col(c).cast("string").cast("binary"))


def q_size_budget_hashed_ids(spark, sf):
    """One time on a group's every row, ids spread over 60 bits."""
    rows = _by_month(spark, sf, F.conv(F.substring(_digest("id"), 1, 15), 16, 10).cast("long"))
    return over_budget(rows, "host", "month", HOST_BUDGET, weight="size_bytes", tiebreak="tie").filter("drop").select("id", "host")


def q_size_budget_text_ids(spark, sf):
    """Without keys, in order of a text: the same start for all, then a digest."""
    rows = _by_month(spark, sf, F.concat(F.lit("inventory-row-"), _digest("id")))
    return over_budget(rows, None, "month", GLOBAL_BUDGET, weight="size_bytes", tiebreak="tie").filter("drop").select("id")


def q_freed_between(spark, sf):
    e = read_table(spark, sf, "events", ["ts"])
    daily = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return freed_between(daily, None, "day", "n").select("day", "n", F.col("freed").cast("long").alias("freed"))


def q_first_match(spark, sf):
    return _first5(spark, sf).select("id", "rule")


# -- 2.6 sorts --------------------------------------------------------------------------
def q_ordered_catalogue(spark, sf):
    per = reclaim_by_rule(first_match(inv(spark, sf), six_rules().rules(six_rules().names())))
    return ordered_catalogue(per.withColumnRenamed("rule", "name")).join(
        per.withColumnRenamed("rule", "name"), ["name"]).select("seq", "name", "files")


def q_version_order(spark, sf):
    b = _brands(spark, sf).select("p_brand").distinct()
    return global_row_number(b, [version_key("p_brand"), F.col("p_brand")]).select("p_brand", "pos")


def q_global_drop_last_n(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "ts"])
    return drop_last_n(e, "ts", KEEP_N, tiebreak="event_id")


# -- 2.7 sets ---------------------------------------------------------------------------
def q_union_steps(spark, sf):
    steps = [name_glob_any(["*.pyc"]), under_dir("/home", named(".cache"))]
    return union_steps(inv(spark, sf), steps).select("id", "path")


def q_union_step_frames(spark, sf):
    """G1 over different inputs: a path named by both steps comes once."""
    trash = system_inventory(spark, sf).filter(contents_of("/root/.local/share/Trash"))
    pyc = inv(spark, sf).filter(name_glob_any(["*.pyc"]))
    below_tmp = system_inventory(spark, sf).filter(below("/tmp") | below("/root/.local"))
    return union_step_frames([f.select("host", "path") for f in (trash, pyc, below_tmp)], ["host", "path"])


# -- 2.8 scalars ---------------------------------------------------------------------------
def q_format_bytes(spark, sf):
    i = inv(spark, sf).select(F.lit("inv").alias("src"), "id", F.col("size_bytes").alias("bytes"))
    d = read_table(spark, sf, "documents", ["doc_id", "n_chars"]).select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.col("n_chars").alias("bytes"))
    u = i.unionByName(d)
    return u.select("src", "id", "bytes", format_bytes("bytes").alias("label"))


def q_format_duration(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "value"])
    v, u = format_duration("value")
    return e.select("event_id", v.alias("dur_value"), u.alias("dur_unit"))


def q_base_name(spark, sf):
    p = read_table(spark, sf, "pages", ["page_id", "url"])
    return p.select("page_id", base_name("url").alias("name"))


def q_parent_dir(spark, sf):
    return inv(spark, sf).select("id", parent_dir("path").alias("parent"))


def q_status_label(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    err = F.when(F.col("o_orderpriority").startswith("1-"), F.lit("urgent"))
    return o.select("o_orderkey", status_label(F.col("o_orderstatus") == "P", err).alias("status"))


def q_size_label(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "value"])
    n = F.floor("value").cast("long")
    return e.select("event_id", n.alias("bytes"), size_label(n).alias("label"))


def q_text_helpers(spark, sf):
    e = read_table(spark, sf, "events", ["event_id", "event_type", "props"])
    return e.select("event_id",
                    trim_chars(field("props", ":", 0), '{" ').alias("k"),
                    trim_chars(field("props", ":", 1), " }").alias("v"),
                    F.lower("event_type").alias("kind"),
                    F.col("props").contains("9").alias("has9"))


# -- J1 and the minimum slice --------------------------------------------------------
def q_custom_rule(spark, sf):
    book = six_rules()
    book.register("big_vdi", name_glob_any(["*.vdi"]) & size_over(100, MIB), roots=["/home"])
    return reclaim_by_rule(first_match(inv(spark, sf), book.rules(["big_vdi"])))


def q_user_logs(spark, sf):
    return reclaim_by_rule(first_match(inv(spark, sf), file_rulebook(AS_OF).rules(["user_logs"])))


def q_catalogue_run(spark, sf):
    """All file-tree rules of the catalogue, in one scan, first match, with total."""
    book = file_rulebook(AS_OF)
    return with_grand_total(first_match(inv(spark, sf, names=True), book.rules(book.names())))


# -- a second inventory, of system and root paths, derived from `orders` ---------------
def q_catalogue_run_system(spark, sf):
    """The whole catalogue over an inventory with rows for every rule that acts
    outside /home or on names the first inventory lacks."""
    book = file_rulebook(AS_OF)
    return with_grand_total(first_match(system_inventory(spark, sf), book.rules(book.names())))


# -- §2.10 listing and log cleaners, over listings derived from the given tables --
JOURNAL_SIZE_FACTOR = 104857  # entry bytes = value * this (about value / 10 MiB)


def _host(n) -> Column:
    return F.concat(F.lit("h"), n.cast("string"))


def log_entries(spark, sf) -> DataFrame:
    e = read_table(spark, sf, "events", ["event_id", "user_id", "ts", "value"])
    return e.select(_host(F.col("user_id") % 4).alias("host"), F.col("event_id").alias("id"), "ts",
                    F.floor(F.col("value") * JOURNAL_SIZE_FACTOR).cast("long").alias("size_bytes"))


def package_lines(spark, sf) -> DataFrame:
    p = read_table(spark, sf, "part", ["p_type", "p_size"])
    return p.select(F.col("p_type").alias("host"),
                    F.concat(F.lit("ii  linux-image-5.4.0-"), F.col("p_size").cast("string"),
                             F.lit("-generic  5.4.0  amd64  Linux kernel image")).alias("line"))


def running_kernels(spark, sf) -> DataFrame:
    """Another kernel runs on each host; some run one that is not listed."""
    p = read_table(spark, sf, "part", ["p_type", "p_partkey"])
    return p.groupBy(F.col("p_type").alias("host")).agg(F.concat(
        F.lit("-5.4.0-"), (F.min("p_partkey") % 60 + 1).cast("string"), F.lit("-generic")).alias("current"))


def snap_lines(spark, sf) -> DataFrame:
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    return o.select(_host(F.col("o_custkey") % 4).alias("host"), F.concat(
        F.lit("snap"), (F.col("o_custkey") % 10).cast("string"), F.lit("  1.0  "),
        F.col("o_orderkey").cast("string"), F.lit("  "),
        F.when(F.col("o_orderstatus") == "F", F.lit("disabled")).otherwise(F.lit("-"))).alias("line"))


def gem_rows(spark, sf) -> DataFrame:
    d = read_table(spark, sf, "documents", ["doc_id", "source", "n_chars"])
    return d.select(_host(F.col("doc_id") % 3).alias("host"), F.col("source").alias("gem"),
                    F.concat((F.col("n_chars") % 50).cast("string"), F.lit("."),
                             (F.col("doc_id") % 7).cast("string")).alias("version"), F.col("doc_id").alias("id"))


def image_lines(spark, sf) -> DataFrame:
    p = read_table(spark, sf, "part", ["p_partkey", "p_brand"])
    return p.select(_host(F.col("p_partkey") % 7).alias("host"), F.concat(
        F.lit("img"), F.col("p_partkey").cast("string"), F.lit(","), F.col("p_brand"), F.lit(",x")).alias("line"))


def container_lines(spark, sf) -> DataFrame:
    """A container for each line item, on a host by its supplier, of the image of its part."""
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return li.select(_host(F.col("l_suppkey") % 7).alias("host"), F.concat(
        F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
        F.lit(",img"), F.col("l_partkey").cast("string")).alias("line"))


def running_containers(spark, sf) -> DataFrame:
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"])
    return li.filter("l_returnflag <> 'R'").select(_host(F.col("l_suppkey") % 7).alias("host"), F.concat(
        F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("container"))


def snapshot_lines(spark, sf) -> DataFrame:
    e = read_table(spark, sf, "events", ["event_id", "user_id", "ts"])
    return e.select(_host(F.col("user_id")).alias("host"), F.concat(
        F.lit("  "), F.col("event_id").cast("string"), F.lit("  >  "),
        F.date_format("ts", STAMP_FORMAT), F.lit("  O  user")).alias("line"))


def env_docs(spark, sf) -> DataFrame:
    e = read_table(spark, sf, "events", ["event_id", "user_id", "event_type"])
    return e.select(_host(F.col("user_id") % 4).alias("host"), F.concat(
        F.lit('{"envs": ["/opt/conda/envs/base", "/opt/conda/envs/'), F.col("event_type"), F.lit("_"),
        (F.col("event_id") % 50).cast("string"), F.lit('"]}')).alias("doc"))


def sdk_lines(spark, sf) -> DataFrame:
    p = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_size"])
    kind = F.when(F.col("p_size") % 3 == 0, "system-images;").when(F.col("p_size") % 3 == 1, "emulator;").otherwise("tools;")
    return p.select(_host(F.col("p_partkey") % 4).alias("host"), F.concat(
        kind, F.regexp_replace("p_name", " ", "-"), F.lit("   | 1.0 | Installed")).alias("line"))


def installed_packages(spark, sf) -> DataFrame:
    s = read_table(spark, sf, "supplier", ["s_suppkey"])
    name = F.when(F.col("s_suppkey") % 3 == 0, "nano").when(F.col("s_suppkey") % 3 == 1, "vim-tiny").otherwise("bash")
    return s.select(_host(F.col("s_suppkey")).alias("host"), name.alias("package"))


def artifact_items(spark, sf) -> DataFrame:
    c = read_table(spark, sf, "customer", ["c_custkey"])
    return c.select(_host(F.col("c_custkey") % 4).alias("host"), F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("item"),
                    (F.col("c_custkey") * 1000).cast("bigint").alias("size_bytes"))


def artifact_refs(spark, sf) -> DataFrame:
    """Artifacts in use: those of customers with an order under way; the others' are unused."""
    o = read_table(spark, sf, "orders", ["o_custkey", "o_orderstatus"]).filter("o_orderstatus = 'P'")
    return o.select(_host(F.col("o_custkey") % 4).alias("host"), F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("item"))


def run_inputs(spark, sf) -> dict:
    """Every named input of a run, from the given tables."""
    from reclaim.plans.listing_rules import ARTIFACT_RULES
    made = {"log": log_entries, "binlogs": log_entries, "packages": package_lines, "running": running_kernels,
            "installed": installed_packages, "snaps": snap_lines, "snapshots": snapshot_lines, "envs": env_docs,
            "sdk": sdk_lines, "gems": gem_rows, "lxc_images": image_lines, "lxc_containers": container_lines,
            "lxc_running": running_containers, **{f"{r}_items": artifact_items for r in ARTIFACT_RULES},
            **{f"{r}_refs": artifact_refs for r in ARTIFACT_RULES}}
    return {name: make(spark, sf) for name, make in made.items()}


def q_kernels(spark, sf):
    from reclaim.plans import listing_rules as L
    return L.kernels(package_lines(spark, sf), running_kernels(spark, sf)).select("host", "package", "rule")


def q_snap_revisions(spark, sf):
    from reclaim.plans import listing_rules as L
    return L.snap_revisions(snap_lines(spark, sf)).select("host", "snap", "revision", "rule")


def q_journal(spark, sf):
    from reclaim.plans import listing_rules as L
    return L.journal(log_entries(spark, sf), AS_OF).select("rule", "id")


def q_journal_first_match(spark, sf):
    """The same two rules through a run: every entry in one rule, with bytes."""
    from reclaim.plans.catalogue import rulebook
    from reclaim.plans.run import run
    res = run(spark, inv(spark, sf), rulebook(AS_OF), include="journal,logs",
              approvals=[("journal", "y"), ("logs", "y")], inputs={"log": log_entries(spark, sf)})
    return res.items.select("seq", "rule", "host", F.col("item").cast("bigint").alias("id"), "size_bytes")


def q_ruby_gems(spark, sf):
    from reclaim.plans import listing_rules as L
    return L.old_gems(gem_rows(spark, sf)).select("host", "gem", "version", "id", "rule")


def q_lxc_images(spark, sf):
    from reclaim.plans import listing_rules as L
    used = container_lines(spark, sf).select("host", csv_field("line", 1).alias("image"))
    return L.lxc_images(image_lines(spark, sf), used).select("host", "image", "rule")


def q_lxc_containers(spark, sf):
    from reclaim.plans import listing_rules as L
    return L.lxc_containers(container_lines(spark, sf), running_containers(spark, sf)).select("host", "container", "rule")


def q_timeshift_snapshots(spark, sf):
    from reclaim.plans import listing_rules as L
    return L.timeshift_snapshots(snapshot_lines(spark, sf)).select("host", "stamp", "rule")


def q_conda_envs(spark, sf):
    from reclaim.plans import listing_rules as L
    return L.conda_envs(env_docs(spark, sf)).groupBy("host", "env", "rule").agg(F.count(F.lit(1)).alias("listed"))


def q_android_packages(spark, sf):
    from reclaim.plans import listing_rules as L
    return L.android_packages(sdk_lines(spark, sf)).select("host", "package", "rule")


def q_mysql_binlogs(spark, sf):
    from reclaim.plans import listing_rules as L
    return L.binlogs(log_entries(spark, sf), AS_OF).select("host", "id", "rule")


def q_apt_packages(spark, sf):
    from reclaim.plans import listing_rules as L
    return L.apt_packages(installed_packages(spark, sf)).select("host", "package", "rule")


def q_unused_artifacts(spark, sf):
    """docker, podman, buildah, flatpak and pnpm: one rule shape, five names."""
    from reclaim.plans import listing_rules as L
    items, refs = artifact_items(spark, sf), artifact_refs(spark, sf)
    return union_apart([L.unused(items, refs, ["host", "item"], r) for r in L.ARTIFACT_RULES])


def q_full_run(spark, sf):
    """All 50 rules, all inputs: files and bytes of every step."""
    from reclaim.plans.catalogue import rulebook
    from reclaim.plans.run import run
    book = rulebook(AS_OF)
    res = run(spark, inv(spark, sf).unionByName(system_inventory(spark, sf)), book, all_rules=True,
              approvals=[(n, "y") for n in book.names()], inputs=run_inputs(spark, sf))
    return res.report.select("seq", "name", "status", "files", "bytes")


# -- rules that apply to some hosts, and texts that do not parse -----------------------
#: Fixed: the tools of the derived hosts, two to a host.
FLEET_TOOLS = ["vboxmanage", "docker", "docker", "snap", "mysql", "vboxmanage", "mariadb", "snap"]
FLEET_RULES = "virtualbox,wine,docker,snap,mysql_mariadb,python,maven,apt"


def fleet_tools(spark, sf) -> DataFrame:
    """A tool of one of four hosts for each customer."""
    c = read_table(spark, sf, "customer", ["c_custkey"])
    at = F.col("c_custkey") % 4 * 2 + F.floor(F.col("c_custkey") / 4) % 2
    return c.select(_host(F.col("c_custkey") % 4).alias("host"),
                    F.element_at(F.array(*[F.lit(t) for t in FLEET_TOOLS]), at.cast("int") + 1).alias("tool"))


def q_tool_status(spark, sf):
    """A step's hosts, and its status where its tool is on none of them."""
    from reclaim.plans.catalogue import rulebook
    from reclaim.plans.run import run
    book = rulebook(AS_OF)
    res = run(spark, inv(spark, sf), book, include=FLEET_RULES, approvals=[(n, "y") for n in book.names()],
              host_tools=fleet_tools(spark, sf), inputs=run_inputs(spark, sf))
    return res.report.select("seq", "name", "status", "hosts_applicable", "hosts_not_applicable")


def q_run_stored(spark, sf):
    """A6 + D3: a run stored in versions, its report from the stored plan."""
    from reclaim.plans.run import run
    book = six_rules()
    res = run(spark, inv(spark, sf), book, all_rules=True, approvals=[(n, "y") for n in book.names()])
    return res.store(scratch_path(spark, "run")).report.select("seq", "name", "status", "files", "bytes")


def broken_docs(spark, sf) -> DataFrame:
    """``env_docs`` as it comes from failing hosts: cut short, other JSON, empty."""
    e = read_table(spark, sf, "events", ["event_id", "user_id"])
    n = F.col("event_id") % 10
    doc = (F.when(n == 0, '{"envs": ["/opt/a"').when(n == 1, '{"other": 1}').when(n == 2, "  ").when(n == 3, F.lit(None))
           .when(n == 4, "no json").otherwise('{"envs": ["/opt/a"]}'))
    return e.select(_host(F.col("user_id") % 4).alias("host"), doc.alias("doc"))


def short_lines(spark, sf) -> DataFrame:
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    line = F.when(F.col("o_orderkey") % 7 == 0, "snap1  1.0").when(F.col("o_orderkey") % 7 == 1, "core").otherwise("core 1 2 x disabled")
    return o.select(_host(F.col("o_custkey") % 4).alias("host"), line.alias("line"))


def q_listing_quarantine(spark, sf):
    """A2-A5: what does not parse, counted by input, host and reason."""
    from reclaim.plans.catalogue import rulebook
    from reclaim.plans.run import run
    book = rulebook(AS_OF)
    res = run(spark, inv(spark, sf), book, include="conda,snap", approvals=[(n, "y") for n in book.names()],
              inputs={"envs": broken_docs(spark, sf), "snaps": short_lines(spark, sf)})
    return res.quarantine.groupBy("input", "host", "reason").agg(F.count(F.lit(1)).alias("texts"))


def q_version_order_full(spark, sf):
    """F2 over versions with pre-releases, suffixes and zeros."""
    p = read_table(spark, sf, "part", ["p_partkey", "p_size"])
    ends = F.element_at(F.array(*[F.lit(x) for x in VERSION_ENDS]), (F.col("p_partkey") % len(VERSION_ENDS)).cast("int") + 1)
    v = p.select(F.concat((F.col("p_size") % 13).cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string"), ends).alias("version")).distinct()
    return global_row_number(v, [version_key("version")]).select("version", "pos")


#: Fixed: endings of a version, in version order.
VERSION_ENDS = ["~alpha", "~rc1", "~rc2", "", "a", "rc1", "+b1", "-1", "-2", "-10"]


# -- the DataFrame forms of selection and consent, over a catalogue that is a table -----
def brand_catalogue(spark, sf) -> DataFrame:
    """A rule table of the brands; those with an even number need consent."""
    b = _brands(spark, sf).select(F.col("p_brand").alias("name")).distinct()
    return b.withColumn("requires_approval", F.substring("name", 7, 9).cast("int") % 2 == 0)


def q_select_rules_frame(spark, sf):
    """C5 + F1 + G2 as DataFrames."""
    from reclaim.operators import select_rules
    c = brand_catalogue(spark, sf)
    modes = {"exclude": {"exclude": "Brand#12,Brand#21"}, "all": {"all_rules": True}, "include": {"include": "Brand#21,Brand#12,Brand#21"}}
    parts = [select_rules(spark, c, **how).select(F.lit(m).alias("mode"), "seq", "name") for m, how in modes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_approval_gate_frame(spark, sf):
    """C8 as a DataFrame: consent is given to the brands whose number 3 divides."""
    from reclaim.operators import approval_gate
    c = brand_catalogue(spark, sf)
    given = c.select("name", F.when(F.substring("name", 7, 9).cast("int") % 3 == 0, "Y").otherwise("no").alias("ans"))
    return approval_gate(ordered_catalogue(c), c, given).select("seq", "name", "requires_approval", "skipped")


MANY_USERS = 1000


def many_rules() -> RuleBook:
    """2,000 user rules: logs and temporary files of each home, above a size of its own."""
    book = RuleBook()
    for u in range(MANY_USERS):
        for end in (".log", ".tmp"):
            book.register_where(f"u{u}{end}", f"/home/u{u}", end, kind="f", size_over=u * 1000)
    return book


def q_many_rules(spark, sf):
    """C1 + E7 + J1: 2,000 registered rules through the index."""
    book = many_rules()
    return reclaim_by_rule(first_match(inv(spark, sf), book.rules(book.names())))


def q_dir_contents_labels(spark, sf):
    """C2 through interval labels: what a shell * names in directories by their
    names, some of them within each other."""
    i = inv(spark, sf)
    test = dir_name_glob("proj?", ".l*", "my-*app", "build")
    return DirTree.of(i).under(i, "/home", test, skip_hidden=True).select("id", "path")


QUERIES: dict[str, Q] = {
    "many_rules": q_many_rules,
    "select_rules_frame": q_select_rules_frame,
    "approval_gate_frame": q_approval_gate_frame,
    "dir_contents_labels": q_dir_contents_labels,
    "tool_status": q_tool_status,
    "run_stored": q_run_stored,
    "listing_quarantine": q_listing_quarantine,
    "version_order_full": q_version_order_full,
    "scan_roots": q_scan_roots,
    "listing_csv_first": q_listing_csv_first,
    "listing_ws_field": q_listing_ws_field,
    "listing_json_envs": q_listing_json_envs,
    "listing_regex_stamps": q_listing_regex_stamps,
    "write_plan_roundtrip": q_write_plan_roundtrip,
    "filter_kind": q_filter_kind,
    "filter_name_in": q_filter_name_in,
    "filter_name_globs": q_filter_name_globs,
    "filter_path_glob": q_filter_path_glob,
    "filter_not_under": q_filter_not_under,
    "filter_age_mtime": q_filter_age_mtime,
    "filter_age_atime": q_filter_age_atime,
    "filter_size": q_filter_size,
    "filter_depth": q_filter_depth,
    "filter_contains_any": q_filter_contains_any,
    "filter_line_matches": q_filter_line_matches,
    "retain_by_age": q_retain_by_age,
    "retain_day_boundary": q_retain_day_boundary,
    "rule_overlap": q_rule_overlap,
    "dir_contents": q_dir_contents,
    "dir_contents_skip_hidden": q_dir_contents_skip_hidden,
    "marker_dirs": q_marker_dirs,
    "marker_dirs_with_dirs": q_marker_dirs_with_dirs,
    "unreferenced": q_unreferenced,
    "unknown_names": q_unknown_names,
    "select_include": q_select_include,
    "select_exclude": q_select_exclude,
    "tool_gate": q_tool_gate,
    "approval_gate": q_approval_gate,
    "reclaim_by_rule": q_reclaim_by_rule,
    "reclaim_rollup": q_reclaim_rollup,
    "run_report": q_run_report,
    "run_report_columns": q_run_report_columns,
    "capped_share": q_capped_share,
    "drop_all_but_latest": q_drop_all_but_latest,
    "superseded": q_superseded,
    "before_current": q_before_current,
    "before_current_no_current": q_before_current_no_current,
    "size_budget": q_size_budget,
    "size_budget_global": q_size_budget_global,
    "size_budget_hashed_ids": q_size_budget_hashed_ids,
    "size_budget_text_ids": q_size_budget_text_ids,
    "freed_between": q_freed_between,
    "first_match": q_first_match,
    "ordered_catalogue": q_ordered_catalogue,
    "version_order": q_version_order,
    "global_drop_last_n": q_global_drop_last_n,
    "union_steps": q_union_steps,
    "union_step_frames": q_union_step_frames,
    "format_bytes": q_format_bytes,
    "format_duration": q_format_duration,
    "base_name": q_base_name,
    "parent_dir": q_parent_dir,
    "status_label": q_status_label,
    "size_label": q_size_label,
    "text_helpers": q_text_helpers,
    "custom_rule": q_custom_rule,
    "user_logs": q_user_logs,
    "catalogue_run": q_catalogue_run,
    "catalogue_run_system": q_catalogue_run_system,
    "full_run": q_full_run,
    "kernels": q_kernels,
    "snap_revisions": q_snap_revisions,
    "journal": q_journal,
    "journal_first_match": q_journal_first_match,
    "ruby_gems": q_ruby_gems,
    "lxc_images": q_lxc_images,
    "lxc_containers": q_lxc_containers,
    "timeshift_snapshots": q_timeshift_snapshots,
    "conda_envs": q_conda_envs,
    "android_packages": q_android_packages,
    "mysql_binlogs": q_mysql_binlogs,
    "apt_packages": q_apt_packages,
    "unused_artifacts": q_unused_artifacts,
}
