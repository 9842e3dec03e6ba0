"""The three jobs of the application: load bar files, draw windows, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns
from windowmatch.operators.layout import lay_out
from windowmatch.operators.windows import draw_windows
from windowmatch.plans.search import pattern_search
from windowmatch.sources import bar_files, tables


def import_bars(spark: SparkSession, path: str, table: str, **options) -> None:
    """Write a directory of bar files into a bars table, which is created if needed.

    Of several rows of one bar the last row of the last file counts. A row that cannot be read fails
    the job and changes nothing.
    """
    bars, _ = bar_files.ingest(spark, path, strict=True, **options)
    if not spark.catalog.tableExists(table):
        tables.create_bars_table(spark, table)
    tables.upsert_into(spark, table, bars, seq=bar_files.SEQ)


def make_windows(
    bars: DataFrame,
    n: int = 10,
    m: int = 100,
    seed: int = 0,
    cols: SearchColumns = SearchColumns(),
    folder: str | None = None,
) -> str:
    """Draw ``m`` windows of ``n`` bars and replace the windows table, or the content of a folder;
    returns the name."""
    drawn = draw_windows(lay_out(bars, cols), cols, n, m, seed)
    if not folder:
        return tables.replace_windows(drawn, n, cols)
    drawn.select(*cols.window_key, cols.period).write.mode("overwrite").parquet(folder)
    return folder


def report(hits: DataFrame, cols: SearchColumns = SearchColumns()) -> list[str]:
    """One line per hit of a search."""
    return [
        f"{r['rank']}. {r['similarity']:.6f}, security {r[cols.sid]}, {r[cols.begin]} to {r[cols.end]}"
        for r in hits.orderBy("rank").collect()
    ]


def search_tables(
    spark: SparkSession, bars: str, windows: DataFrame, k: int = 10, limit: int | None = None
) -> DataFrame:
    """Search the windows of a bars table; the first window, in key order, is the pattern.

    Of the bars, only the months between the first and the last window are read.
    """
    cols = SearchColumns()
    if limit:
        windows = windows.orderBy(*cols.window_key).limit(limit)
    begin, end = windows.agg(F.min(cols.begin), F.max(cols.end)).first()
    return pattern_search(tables.read_bars(spark, bars, begin, end), windows, cols, k)
