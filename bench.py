"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from coffer.catalog import QUERIES  # noqa: E402
from coffer.session import build_session  # noqa: E402

HEADLINE = [
    "agg_by", "stats_by", "dept_rollup", "program_rollup", "metrics", "county_op", "bill_log",
    "compare", "compare_years", "draft_compare", "apply_changes", "fuzzy_match", "augment",
    "dept_series", "feed_rollup", "currency", "lines", "html_text", "line_kinds",
    "bill_allocations", "projects", "grants", "nearest_col", "deltas",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), progress=False)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["agg_by"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
