"""Command line: ``import``, ``draw`` and ``search``.

Tables are named by the folder they are in (anything with a slash), which works from one process to the
next, or by their name in a catalog that outlives the session.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from windowmatch.config import SearchColumns
from windowmatch.operators.upsert import latest
from windowmatch.plans import jobs
from windowmatch.sources import bar_files, tables
from windowmatch.staging import release


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="windowmatch")
    commands = parser.add_subparsers(dest="command", required=True)

    files = argparse.ArgumentParser(add_help=False)
    files.add_argument("--dt", default="datetime", help="time column of the files")
    files.add_argument("--dt-format", default=bar_files.DEFAULT_TIME_FORMAT)
    files.add_argument("--delimiter", default=",")
    files.add_argument("--mixed", action="store_true", help="the headers of the files differ")

    load = commands.add_parser("import", parents=[files], help="load bar files into a table")
    load.add_argument("--data-path", required=True)
    load.add_argument("--table", required=True)

    draw = commands.add_parser("draw", parents=[files], help="draw random windows into a table")
    source = draw.add_mutually_exclusive_group(required=True)
    source.add_argument("--data-path")
    source.add_argument("--table")
    draw.add_argument("--n", type=int, default=10, help="bars per window")
    draw.add_argument("--m", type=int, default=100, help="number of windows")
    draw.add_argument("--seed", type=int, default=0)
    draw.add_argument("--namespace", help="where the table windows<n> is replaced")
    draw.add_argument("--out", help="folder for the windows, instead of a table")

    search = commands.add_parser("search", help="print the windows most similar to the first")
    search.add_argument("--table", required=True)
    search.add_argument("--windows", required=True)
    search.add_argument("--k", type=int, default=10)
    search.add_argument("--limit", type=int, help="search only this many windows")
    return parser


def _bars(spark: SparkSession, table: str) -> str:
    return tables.bars_folder(spark, table) if "/" in table else table


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("windowmatch").getOrCreate()
    try:
        _run(args, spark)
    finally:
        release(spark)


def _run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.command == "search":
        found = spark.read.parquet(args.windows) if "/" in args.windows else spark.table(args.windows)
        hits = jobs.search_tables(spark, _bars(spark, args.table), found, args.k, args.limit)
        print("\n".join(jobs.report(hits)))
        return
    options = {
        "sep": args.delimiter,
        "time_column": args.dt,
        "time_format": args.dt_format,
        "mixed": args.mixed,
    }
    if args.command == "import":
        jobs.import_bars(spark, args.data_path, _bars(spark, args.table), **options)
        return
    if args.table:
        bars = tables.read_bars(spark, _bars(spark, args.table))
    else:
        bars, _ = bar_files.ingest(spark, args.data_path, strict=True, **options)
        bars = latest(bars, tables.BARS_KEY, bar_files.SEQ)
    cols = SearchColumns(namespace=args.namespace)
    print(jobs.make_windows(bars, args.n, args.m, args.seed, cols, args.out))


if __name__ == "__main__":
    main()
