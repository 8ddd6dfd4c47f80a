"""Run the review and write its results; for spark-submit.

    spark-submit --conf spark.checkpoint.dir=hdfs:///shared/checkpoints \\
        --py-files tabular_audit.zip run_review.py \\
        --table projects=/data/projects --table projects_detail=/data/detail ... \\
        --out /data/review [--format csv] [--only status_within_admin ...]
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabular_audit.plans import RESULTS, ROW_RESULTS, Portfolio, Review, report_orders  # noqa: E402
from tabular_audit.session import with_settings  # noqa: E402
from tabular_audit.sources import SCHEMAS, read_portfolio, write_reports  # noqa: E402


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Review a portfolio of six tables.")
    parser.add_argument("--table", action="append", required=True, metavar="NAME=PATH",
                        help="one per input table: " + ", ".join(SCHEMAS))
    parser.add_argument("--out", required=True, help="folder for the results")
    parser.add_argument("--format", default="parquet", choices=["parquet", "orc", "json", "csv"])
    parser.add_argument("--out-format", default="parquet", choices=["parquet", "orc", "json", "csv"])
    parser.add_argument("--multiline", action="store_true", help="CSV or JSON cells hold line breaks")
    parser.add_argument("--only", nargs="+", choices=sorted(RESULTS), metavar="RESULT")
    parser.add_argument("--no-keep", action="store_true",
                        help="do not write widened tables to spark.checkpoint.dir")
    parser.add_argument("--parallel", type=int, default=4, help="results written at the same time")
    args = parser.parse_args(argv)

    spark = with_settings(SparkSession.builder.appName("review")).getOrCreate()
    paths = dict(entry.split("=", 1) for entry in args.table)
    tables = read_portfolio(spark, paths, args.format, args.multiline)
    review = Review(Portfolio.of(tables), keep=not args.no_keep)
    results = {name: review.result(name) for name in args.only or RESULTS}
    write_reports(results, args.out, args.out_format, large=ROW_RESULTS, parallel=args.parallel,
                  order_by=report_orders(results))


if __name__ == "__main__":
    main()
