"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the cores.
One count starts the session; then each query is built, planned and run once, every result
row produced and none kept.
"""

from __future__ import annotations

import json
import os
import time

from lotwise.plans.everything import QUERIES
from lotwise.session import local_session

HEADLINE = (
    "f1_default_sort",
    "d2_facets",
    "d3_totals",
    "b5_status_live",
    "f4_relevance",
    "c7_nearby_all",
    "c1_candidate_pairs",
    "h7_scan",
    "h5_classify",
    "e1_url_state",
    "e6_documents",
    "e2_upsert",
    "e3_revisions",
    "e7_advance_statuses",
    "a9_extract_payload",
    "a12_parse_property",
    "a6_canonical_sha256",
    "d8_crawl_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    QUERIES["d6_count_published"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
