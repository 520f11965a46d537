"""Batch jobs: ``spark-submit <this package> explore|clean|analyse ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ledgerloom.operators.enrich import ORDER_STATUSES
from ledgerloom.plans.analysis import run_analysis
from ledgerloom.plans.cleaning import run_cleaning
from ledgerloom.plans.exploration import audits, distributions, profile_tables
from ledgerloom.sources.readers import load_csv_tables


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerloom")
    commands = parser.add_subparsers(dest="command", required=True)

    explore = commands.add_parser("explore", help="print profiles and distributions of raw tables")
    explore.add_argument("raw_path")
    explore.add_argument("--prefix", default="", help="file prefix of the raw CSV files")
    explore.add_argument("--rows", type=int, default=20, help="rows to print per result")

    clean = commands.add_parser("clean", help="clean raw CSV tables into Parquet")
    clean.add_argument("raw_path")
    clean.add_argument("cleaned_path")
    clean.add_argument("--prefix", default="", help="file prefix of the raw CSV files")
    clean.add_argument("--single-file", action="store_true", help="one file per table")
    clean.add_argument("--fail-on-malformed", action="store_true",
                       help="end before anything is overwritten if a field does not parse")

    analyse = commands.add_parser("analyse", help="integrate cleaned tables and write the outputs")
    analyse.add_argument("cleaned_path")
    analyse.add_argument("analysed_path")
    analyse.add_argument("--database", help="also save every output as a table of this database")

    analyse.add_argument("--partition-orders-by", nargs="*", default=[], metavar="COLUMN",
                         help="folder columns of the complete orders, e.g. purchase_year")
    analyse.add_argument("--declared-statuses", action="store_true",
                         help="one flag per declared status, not per status that occurs")

    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"ledgerloom {args.command}").getOrCreate()
    if args.command == "explore":
        tables = load_csv_tables(spark, args.raw_path, prefix=args.prefix)
        for name, df in {**profile_tables(tables), **audits(tables), **distributions(tables)}.items():
            print(f"\n{name}")
            df.show(args.rows, truncate=False)
    elif args.command == "clean":
        run_cleaning(spark, args.raw_path, args.cleaned_path,
                     prefix=args.prefix, single_file=args.single_file,
                     on_malformed="fail" if args.fail_on_malformed else "quarantine")
    else:
        run_analysis(spark, args.cleaned_path, args.analysed_path,
                     database=args.database,
                     statuses=ORDER_STATUSES if args.declared_statuses else None,
                     partition_orders_by=args.partition_orders_by)


if __name__ == "__main__":
    main()
