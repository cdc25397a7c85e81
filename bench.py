"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job is executed to completion with the no-op sink (full execution, no
driver collect).  One warm-up job runs first so JVM start-up is not charged to
the first query.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewater.registry import queries  # noqa: E402
from tidewater.session import local_session  # noqa: E402

HEADLINE = [
    "r28_search",          # table of searches x documents corpus (flagship)
    "r24_search_totals",
    "m6_top_matches",      # all profiles x all notices, top 10 each
    "m6_match_totals",
    "i2_upsert",           # change-detecting merge of the events feed
    "i6_run_summary",
    "a2_portal_breakdown",
    "a7_member_funnel",
    "n14_classify_feed",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "tidewater-bench")
    qs = queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # warm-up
    times = {}
    for name in HEADLINE:
        if name not in qs:
            continue
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
