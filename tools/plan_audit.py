"""Audit the physical plans of all registered queries: shuffles, broadcasts,
nested-loop / cartesian joins, Python stages and single-partition windows.
python tools/plan_audit.py [sf_dir]  -> markdown table on stdout."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docsift.plans.registry import registry  # noqa: E402
from docsift.session import get_spark  # noqa: E402


def audit(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "nested_loop": len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan)),
        "python": len(re.findall(r"ArrowEvalPython|MapInPandas|BatchEvalPython|FlatMapGroupsInPandas", plan)),
    }


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark("local[4]")
    print("| query | shuffles | of which single-partition | broadcasts | nested-loop joins | Python stages |")
    print("|---|---|---|---|---|---|")
    for name, spec in sorted(registry().items()):
        df = spec.build(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        a = audit(plan)
        print(f"| `{name}` | {a['shuffles']} | {a['single']} | {a['broadcasts']} | {a['nested_loop']} | {a['python']} |",
              flush=True)
