"""Projections, filters, counts and key lists over bars and windows."""

from __future__ import annotations

from weakref import WeakSet

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns


# The column a bars table is split by: 100 times the year and the month.
MONTH = "bar_month"
# Frames as read_bars returns them: the column is behind them, though not among theirs.
_by_month: WeakSet[DataFrame] = WeakSet()


def month_of(time: Column) -> Column:
    return F.year(time) * 100 + F.month(time)


def stored_by_month(bars: DataFrame) -> DataFrame:
    """Tells that filters on the time of ``bars`` can name the month, too."""
    _by_month.add(bars)
    return bars


def project(bars: DataFrame, cols: SearchColumns, *extra: str) -> DataFrame:
    """Key and match columns only, so the scan reads nothing else."""
    return bars.select(*dict.fromkeys((*cols.bar_key(bars), *cols.match, *extra)))


def by_sid(bars: DataFrame, cols: SearchColumns, sid: int) -> DataFrame:
    return bars.where(F.col(cols.sid) == F.lit(sid))


def by_time(bars: DataFrame, cols: SearchColumns, begin, end) -> DataFrame:
    """Bars of a closed time range. Bounds take the type of the time column.

    Of a table split by month, only the months of the range are read.
    """
    kind = bars.schema[cols.time].dataType
    bounds = [F.lit(bound).cast(kind) for bound in (begin, end)]
    found = bars.where(F.col(cols.time).between(*bounds))
    if bars in _by_month or MONTH in bars.columns:
        found = found.where(F.col(MONTH).between(*map(month_of, bounds)))
    return found


def of_sampled_sids(bars: DataFrame, windows: DataFrame, cols: SearchColumns) -> DataFrame:
    """Bars of the securities that occur in ``windows``."""
    return bars.join(distinct_sids(windows, cols), cols.sid, "left_semi")


def distinct_sids(rows: DataFrame, cols: SearchColumns) -> DataFrame:
    return rows.select(cols.sid).distinct()


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"))


def sid_lists(rows: DataFrame, cols: SearchColumns, width: int = 1000) -> DataFrame:
    """Comma-separated security ids, one list per ``width`` consecutive ids.

    A list therefore never holds more than ``width`` ids, however many there are.
    """
    block = F.floor(F.col(cols.sid) / F.lit(width)).cast("long").alias("block")
    return (
        distinct_sids(rows, cols)
        .groupBy(block)
        .agg(F.array_join(F.sort_array(F.collect_set(cols.sid)), ",").alias("sids"))
    )


def first_windows(windows: DataFrame, cols: SearchColumns, limit: int) -> DataFrame:
    """The first ``limit`` windows in key order."""
    return windows.orderBy(*cols.window_key).limit(limit)
