"""Count shuffles, broadcasts, Python nodes and sorts in each registered
query's physical plan (before AQE re-planning).

    python tests/plan_census.py [sf_dir]
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def census(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "python": len(re.findall(r"FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)),
        "windows": len(re.findall(r"\bWindow\b", plan)),
        "smj": plan.count("SortMergeJoin"),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from xgspark.session import build_session

    spark = build_session("local[8]", "census", 8)
    print("| query | shuffles | broadcasts | sort-merge joins | windows | python nodes |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, fn in E.queries().items():
        c = census(fn(spark, sf))
        print(f"| `{name}` | {c['shuffles']} | {c['broadcasts']} | {c['smj']} | {c['windows']} | {c['python']} |")


if __name__ == "__main__":
    main()
