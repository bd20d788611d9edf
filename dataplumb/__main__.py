"""Command line: profile or check a file. Exit code 1 means that a check failed."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .session import Session
from .sources.files import read


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="dataplumb")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("profile", help="statistics of every column")
    two = commands.add_parser("quality", help="check volume and nulls")
    for p in (one, two):
        p.add_argument("file")
    one.add_argument("--format", choices=("table", "csv", "json"), default="table")
    two.add_argument("--volume-min", type=int)
    two.add_argument("--null-max", type=float)
    two.add_argument("--column")
    args = parser.parse_args(argv)
    rules = {}
    if args.command == "quality":
        if args.null_max is not None and not args.column:
            parser.error("--null-max requires --column")
        if args.volume_min is not None:
            rules["volume"] = {"min_rows": args.volume_min}
        if args.null_max is not None:
            rules["null_rate"] = {"column": args.column, "max_null_rate": args.null_max}
        if not rules:
            parser.error("give --volume-min or --null-max")
    dq = Session(spark)
    df = read(dq.spark, args.file)
    if args.command == "quality":
        result = dq.quality_check(df, rules)
        print(json.dumps({"status": result.status, "checks": result.checks}, default=str))
        return 0 if result.status == "pass" else 1
    frame = dq.profile(df).toPandas()
    print(frame.to_csv(index=False) if args.format == "csv" else frame.to_json(orient="records", default_handler=str) if args.format == "json" else frame.to_string(index=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
