"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads,
BENCH_QUERIES (optional, comma-separated) other queries than the headline ones.
Each query is built and fully evaluated into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabular_audit.queries import QUERIES  # noqa: E402
from tabular_audit.session import with_settings  # noqa: E402

HEADLINE = [
    "completeness_by_group", "completeness_at_levels", "completeness_by_group_year",
    "populated_breakdown", "predicate_rate_by_group", "zero_rate_by_group_all",
    "share_total", "share_within", "stats_by", "describe_amounts", "duration_weeks_by",
    "reconcile_values", "rule_check_three", "cohort_years", "enrich_null_safe",
    "join_with_fan_out", "wide_report", "membership_flags", "unmatched_keys", "key_matches",
    "duplicate_line_rows", "duplicate_key_counts", "drop_and_distinct", "distinct_with_null",
    "id_families", "portfolio_wide", "portfolio_detail_completeness",
    "portfolio_metric_completeness", "portfolio_budget", "portfolio_barriers_by_start_year",
    "portfolio_detail_completeness_kept",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = with_settings(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
