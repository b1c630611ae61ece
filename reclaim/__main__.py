"""Command line: plan a run over an inventory table and print the report.

    python -m reclaim --inventory PATH (--all | -i a,b | -x a,b) [--as-of TS] [--home /root]
                      [--approve-all | --approve name=ans ...] [--error name=text ...]
                      [--host-tools PATH] [--timings PATH] [--start-free BYTES]
                      [--input name=PATH ...] [--text-input name@host=PATH ...]
                      [--plan-out PATH] [--items-out PATH] [--report-out PATH]

The inventory is Parquet with ``host, path, kind, size_bytes, mtime, atime, id``;
host tools (``host, tool``), timings (``seq, duration_s``) and further inputs
(names and columns in ``reclaim.plans.listing_rules.INPUTS``) are Parquet too, or a
listing of one host as text, by line (JSON listings by file).
A name run several times takes its answers in order, or one for all, or
``position=answer``.  The report (one row per selected rule) is printed whole;
plan tables are written (partitioned by rule), never collected.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="reclaim")
    ap.add_argument("--inventory", required=True)
    ap.add_argument("--all", dest="all_rules", action="store_true")
    ap.add_argument("-i", dest="include", default="")
    ap.add_argument("-x", dest="exclude", default="")
    ap.add_argument("--as-of", default=None)
    ap.add_argument("--home", default="/root")
    ap.add_argument("--approve-all", action="store_true")
    ap.add_argument("--approve", action="append", default=[], help="name=answer")
    ap.add_argument("--error", action="append", default=[], help="name=text of a rule that failed")
    ap.add_argument("--host-tools", default=None)
    ap.add_argument("--timings", default=None)
    ap.add_argument("--start-free", type=int, default=None)
    ap.add_argument("--input", action="append", default=[], help="name=path")
    ap.add_argument("--plan-out", default=None)
    ap.add_argument("--items-out", default=None)
    ap.add_argument("--text-input", action="append", default=[], help="name@host=path")
    ap.add_argument("--report-out", default=None)
    ap.add_argument("--quarantine-out", default=None, help="folder for texts of the inputs that do not parse")
    ap.add_argument("--run-out", default=None, help="folder for plan, items and report of the run")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)

    from reclaim.operators.selection import SelectionError, check_mode
    try:
        check_mode(a.include, a.exclude, a.all_rules)
    except SelectionError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1

    from pyspark.sql import functions as F

    from reclaim.plans.catalogue import rulebook
    from reclaim.plans.listing_rules import INPUTS
    from reclaim.plans.run import run, total_of
    from reclaim.session import get_spark
    from reclaim.sources.listings import read_documents, read_lines
    from reclaim.sources.sinks import read_plan, write_plan, write_report
    from reclaim.sources.tables import read_inventory

    spark = get_spark(a.master)
    as_of = dt.datetime.fromisoformat(a.as_of) if a.as_of else dt.datetime.now().replace(microsecond=0)
    book = rulebook(as_of, a.home)
    split = [x.split("=", 1) for x in a.approve]
    approvals = [(n, "y") for n in book.names()] if a.approve_all else \
        [(int(k), v) if k.isdigit() else (k, v) for k, v in split]
    named = dict(x.split("=", 1) for x in a.input)
    texts = [(*k.split("@", 1), p) for k, p in (x.split("=", 1) for x in a.text_input)]
    if unknown := sorted(({*named} | {n for n, *_ in texts}) - set(INPUTS)):
        print(f"Error: no rule reads an input called {unknown[0]}", file=sys.stderr)
        return 1
    inputs = {n: spark.read.schema(INPUTS[n]).parquet(p) for n, p in named.items()}
    for name, host, path in texts:
        read, column = (read_documents, "doc") if "doc" in INPUTS[name] else (read_lines, "line")
        listing = read(spark, path, column).select(F.lit(host).alias("host"), column)
        inputs[name] = inputs[name].unionByName(listing) if name in inputs else listing
    tools = spark.read.parquet(a.host_tools).select("host", "tool") if a.host_tools else None
    timings = spark.read.parquet(a.timings) if a.timings else None
    try:
        res = run(spark, read_inventory(spark, a.inventory), book, a.include, a.exclude, a.all_rules, approvals,
                  host_tools=tools, errors=[tuple(x.split("=", 1)) for x in a.error],
                  start_free_bytes=a.start_free, timings=timings, inputs=inputs)
    except SelectionError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    if a.run_out:
        res = res.store(a.run_out, measure=not a.timings)
    # what has been written is not worked out again
    if a.plan_out:
        res = res.over(plan=read_plan(spark, write_plan(res.plan, a.plan_out)))
    if a.items_out:
        res = res.over(items=read_plan(spark, write_plan(res.items, a.items_out)))
    if a.quarantine_out and res.quarantine is not None:
        write_plan(res.quarantine, a.quarantine_out, "input")
    rows = res.report.collect()  # one row a step, as many as the arguments name
    report = spark.createDataFrame(rows, res.report.schema).orderBy("seq")
    if a.report_out:
        write_report(report, a.report_out)
    report.select("seq", "name", "status", "files", "freed").show(max(len(rows), 1), truncate=False)
    total_of(report).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
