"""Write the executed physical plans of the headline queries to PLANS.md.

    python tools/dump_plans.py [/root/testdata/sf0.01]

Each plan is the final adaptive plan after a full run over a stored inventory,
trimmed to operator lines, so the shuffles, broadcasts, pushed filters and
windows that the README describes can be checked by eye.  For the queries of
``BEFORE`` the plan before adaptive execution (which drops empty branches)
comes first.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES = ["scan_roots", "first_match", "catalogue_run", "reclaim_rollup", "dir_contents", "marker_dirs",
           "size_budget", "size_budget_global", "drop_all_but_latest", "global_drop_last_n", "superseded",
           "before_current", "unreferenced", "capped_share", "version_order", "freed_between", "many_rules", "dir_contents_labels",
           "size_budget_hashed_ids", "run_stored"]


BEFORE = ["catalogue_run", "size_budget"]


def trim(line: str, width: int = 170) -> str:
    line = re.sub(r"#\d+L?", "", line)
    line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "Location: ...", line)
    return line if len(line) <= width else line[:width] + " ..."


def main():
    from reclaim.plans.queries import QUERIES as Q
    from reclaim.session import get_spark
    from reclaim.sources import store_inventory
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8, extra={
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="reclaim-plans-")})
    out = ["# Executed plans", "", f"Generated by `tools/dump_plans.py` at `{sf}` (local[8], AQE on). "
           "Column ids removed; long lines cut.", ""]
    store_inventory(spark, sf, spark.conf.get("spark.checkpoint.dir") + "/inventory")
    for name in QUERIES:
        df = Q[name](spark, sf)
        if name in BEFORE:
            plan = df._jdf.queryExecution().sparkPlan().toString()
            out += [f"## {name}, before adaptive execution", "", "```"] + [trim(x) for x in plan.splitlines()] + ["```", ""]
        df.collect()  # runs this DataFrame's own execution, so the adaptive plan is final
        plan = re.split(r"\n *\+- == Initial Plan ==", df._jdf.queryExecution().executedPlan().toString())[0]
        out += [f"## {name}", "", "```"] + [trim(x) for x in plan.splitlines()] + ["```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
