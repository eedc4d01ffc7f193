"""Command line: the dataset operations as Spark jobs, JSON out.

    python -m dqlens profile  <csv path>                      # report, nothing stored
    python -m dqlens ingest   <base> <csv path> <dataset> <user> [--name N] [--max-rows R]
    python -m dqlens list     <base> <user>
    python -m dqlens detail   <base> <dataset> <user>
    python -m dqlens status   <base> <dataset> <user>
    python -m dqlens archive  <base> <dataset> <user>

Rows are rendered with ``to_json`` on the executors; only the (small)
answer of each command reaches the driver.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _print(df: DataFrame) -> None:
    for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(row["j"])


def _found(answer) -> int:
    """Print an answer about one dataset, or that it is not there."""
    from dqlens.plans.jobs import DatasetNotFound
    try:
        got = answer()
    except DatasetNotFound as exc:
        print(json.dumps({"error": str(exc)}))
        return 1
    if isinstance(got, DataFrame):
        _print(got)
    else:
        print(json.dumps(got))
    return 0


def main(argv: list[str] | None = None) -> int:
    from dqlens.operators import report as R
    from dqlens.plans import jobs as J
    from dqlens.session import get_spark

    parser = argparse.ArgumentParser(prog="dqlens")
    sub = parser.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("profile")
    p.add_argument("path")
    p = sub.add_parser("ingest")
    for a in ("base", "path", "dataset", "user"):
        p.add_argument(a)
    p.add_argument("--name", default=None)
    p.add_argument("--max-rows", type=int, default=None)
    p = sub.add_parser("list")
    p.add_argument("base")
    p.add_argument("user")
    for cmd in ("detail", "status", "archive"):
        p = sub.add_parser(cmd)
        for a in ("base", "dataset", "user"):
            p.add_argument(a)
    args = parser.parse_args(argv)

    spark = get_spark()
    if args.cmd == "profile":
        _print(R.report_document(J.profile_csv(spark, args.path)))
    elif args.cmd == "ingest":
        _print(J.ingest_and_profile(spark, args.base, args.path, args.dataset, args.user,
                                    custom_name=args.name, max_rows=args.max_rows))
    elif args.cmd == "list":
        _print(J.list_datasets(spark, args.base, args.user))
    elif args.cmd == "detail":
        return _found(lambda: J.get_dataset(spark, args.base, args.dataset, args.user))
    elif args.cmd == "status":
        return _found(lambda: J.get_status(spark, args.base, args.dataset, args.user))
    elif args.cmd == "archive":
        return _found(lambda: J.archive_dataset(spark, args.base, args.dataset, args.user))
    return 0


if __name__ == "__main__":
    sys.exit(main())
