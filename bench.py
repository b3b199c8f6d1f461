"""Times the headline queries, each as the median of three runs (of one, if it is long), and prints one JSON line.

    BENCH_SF_DIR  input directory (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
    BENCH_QUERIES comma-separated names, or 'all'
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from pulseframe.sources.tables import clear_scratch  # noqa: E402
from pulseframe_checks.registry import QUERIES  # noqa: E402

HEADLINE = (
    "daily_from_raw", "tiered_daily", "series_range", "view_daily_quantity", "retention_apply", "retention_keep",
    "upsert_latest", "insert_ignore", "ingest_batch", "ingest_dedupe", "health_summary", "sleep_nights",
    "sleep_sessions", "hrv_trend", "query_metric_raw", "workouts", "daily_snapshot", "long_term_monthly",
    "coaching_brief", "search_records", "metric_stats", "compare_periods", "inventory", "weekly_digest",
    "low_hrv_prior_sleep", "load_before_low_hrv", "suppression_runs", "recovery_score", "rolling_7d",
    "illness_flag", "unit_normalise", "stream_daily",
)


RUNS, LONG = 3, 10  # runs of a query; seconds from which one is enough


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["inventory"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            if runs[0] > LONG:
                break
        seconds[name] = round(statistics.median(runs), 3)
        clear_scratch(spark)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
