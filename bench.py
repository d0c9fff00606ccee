"""Headline queries, timed. Prints one JSON line.

    BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from citeframe.plans.catalog import QUERIES  # noqa: E402
from citeframe.session import build_session  # noqa: E402

HEADLINE = [
    "clean_pages_extraction",
    "chunk_pages",
    "match_chunks",
    "match_chunks_batch",
    "passage_index",
    "number_mentions",
    "verify_citations",
    "same_label_conflicts",
    "integrity_outcomes",
    "validate_proposals",
    "shred_evidence",
    "market_matches",
    "mandates_checked",
    "apply_corrections",
    "suite_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        shuffle_partitions=cpus * 2,
        driver_memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
