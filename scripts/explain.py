"""Summarise the physical plans of the headline queries (PLANS.md).

usage: python scripts/explain.py [sf_dir] > PLANS.md
Lists, per query, the physical operators (with counts), every exchange, and
the scans' pushed filters / read schema, with size-based broadcasts turned
off so the plan is the one a large cluster would run.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import bench  # noqa: E402
from trellis.plans.catalog import load  # noqa: E402
from trellis.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(shuffle_partitions=64)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan, before run-time re-planning
    queries, _ = load()
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `scripts/explain.py {sf_dir}` with size-based broadcast off and AQE off "
          "(the static plan a large cluster starts from).\n")
    for name in bench.HEADLINE:
        df = queries[name](spark, sf_dir)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        text = df._jdf.queryExecution().explainString(mode)
        nodes = Counter()
        for m in re.finditer(r"^\((\d+)\) ([A-Za-z][A-Za-z ]*?)(?: \[codegen id : \d+\])?$", text, re.M):
            nodes[m.group(2).strip()] += 1
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges, scans = [], []
        for line in plan.splitlines():
            if "Exchange" in line and "Reused" not in line:
                exchanges.append(re.sub(r"^[\s:+\-]*", "", line).split(", [plan_id")[0][:140])
            if "FileScan" in line:
                push = re.search(r"PushedFilters: \[([^\]]*)\]", line)
                schema = re.search(r"ReadSchema: (struct<[^>]*>)", line)
                scans.append(f"PushedFilters [{push.group(1) if push else ''}] ReadSchema {schema.group(1) if schema else ''}")
        print(f"## {name}\n")
        print("operators: " + ", ".join(f"{k} ×{v}" for k, v in sorted(nodes.items())) + "\n")
        print("exchanges:\n" + "\n".join(f"- `{e}`" for e in exchanges) + "\n")
        print("scans:\n" + "\n".join(f"- `{s[:220]}`" for s in sorted(set(scans))) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
