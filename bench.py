"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then $BENCH_RUNS times (default 1); the
median is reported. Results are written to the no-op sink, so every row and
column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pagelens.plans.catalog import ENTRIES
from pagelens.session import local_session

HEADLINE = (
    "host_page_report page_links host_link_counts url_validity text_statistics readability frequent_words tfidf_keywords "
    "sentiment language token_categories substring_categories entities display_quality content_validity job_counters "
    "job_statistics report_overview batch_progress session_rollup metric_series tfidf_features duplicate_clusters evaluation"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "pagelens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = {e.name: e for e in ENTRIES}

    def once(name: str) -> float:
        start = time.perf_counter()
        entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
