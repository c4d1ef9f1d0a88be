"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder of the Parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS     threads of the local session (default 8)
    BENCH_RUNS     timed runs per query, the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from mediacat.plans.all_queries import QUERIES
from mediacat.session import build_session

HEADLINE = {
    "q1": "match_rate_by_album",
    "q2": "link_sidecars",
    "q3": "orphan_sidecars",
    "q4": "name_features",
    "q5": "content_fingerprints",
    "q6": "duplicate_files",
    "q7": "rescan_diff",
    "q8": "rescan_catalog",
    "q9": "albums_upserted",
    "q10": "error_breakdown",
    "q11": "counter_audit",
    "q12": "capture_times",
    "q13": "parsed_sidecars",
    "q14": "time_matches",
    "q15": "people_of_media",
    "q16": "items_with_originals",
    "q17": "retained_errors",
    "q18": "verify_archives",
    "q19": "identifiers",
    "q20": "rows_breaking_rules",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for label, name in HEADLINE.items():
        once(name)  # warm up: class loading and code generation
        seconds[label] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median seconds over the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
