"""Time the headline jobs on the driver tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "flagship_report", "f01_merge_feeds", "f02_latest_active", "d01_enrich_with_changes", "d02_match_works",
    "d06_exact_matches", "d06_compare_identity", "d07_pick_unique", "d09_title_lookup", "d17_cross_check", "d22_profile_as_of",
    "e01_coalesce_intervals", "e02_coverage_gaps", "e05_connected_records", "e06_expand_categories",
    "f03_group_issues", "f06_resolve_type", "f08_resolve_records", "f11_issue_coverage", "g01_rank_results",
    "g10_missing_windows", "i02_upsert_seen", "i05_paper_search", "j02_stream_latest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from checks.catalog import QUERIES
    from shelfmark.session import local_session

    spark = local_session(cpus)
    for name in ("b03_title_fold", "f03_group_issues"):  # start the JVM's and Python's workers before timing
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    chosen = sys.argv[1:] or HEADLINE
    spent = {}
    for name in chosen:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline jobs, total wall time", "value": round(sum(spent.values()), 3), "unit": "sec",
        "queries": spent, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
