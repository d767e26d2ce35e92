"""Condensed physical plans of the bench queries (scans, pushed filters, joins, exchanges).

Usage: python tools/show_plans.py [sf_dir] > PLANS.md
Queries built on running totals materialise their range blocks when the
DataFrame is built (eager checkpoint), so their plan starts at the checkpoint.
"""

from __future__ import annotations

import contextlib
import os
import re
import sys
from io import StringIO

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from peakscreen import get_spark  # noqa: E402
from peakscreen.plans import catalog  # noqa: E402

import bench  # noqa: E402


def summary(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        s = line.strip()
        if re.match(r"^\(\d+\) (Scan|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|Exchange|"
                    r"BroadcastExchange|Window|Generate|MapInPandas|HashAggregate|Expand|Sort)", s):
            out.append(s)
        elif s.startswith(("PushedFilters:", "ReadSchema:", "Join type:", "Arguments: hashpartitioning",
                           "Arguments: rangepartitioning", "Arguments: SinglePartition")):
            out.append("    " + s[:200])
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", 8)
    qs = catalog.all_queries()
    print(f"# Physical plans (condensed) at {os.path.basename(sf_dir)}\n")
    print("Generated by `tools/show_plans.py`; AQE may still re-plan joins and coalesce at run time.\n")
    for name in bench.HEADLINE:
        df = qs[name](spark, sf_dir)
        buf = StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        lines = summary(buf.getvalue())
        print(f"## {name}\n\n```")
        print("\n".join(lines) if lines else "(local relation)")
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
