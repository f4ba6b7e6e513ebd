"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glossweave.plans.queries import QUERIES  # noqa: E402
from glossweave.session import build_session, name_scratch  # noqa: E402

HEADLINE = (
    "definitions_long",
    "section_cascade",
    "flat_definitions",
    "written_xdxf",
    "run_stats",
    "streamed_ingest",
    "node_text",
    "clean_text",
    "clean_html",
    "script_filter",
    "script_histogram",
    "sorted_headwords",
    "limited_pages",
    "batch_assignment",
    "collation_order",
    "lemma_candidates",
    "lemma_lookup",
    "merged_dictionary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        app_name="bench",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    name_scratch(spark)
    # Workers and code paths are warm before the first measurement.
    QUERIES["definitions_long"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
