"""Join of windows with the bars they cover: same security, closed time interval.

The bars of a laid-out table stay in their tiles (``tile_join``). For any other bars the join is an equality join on (sid, cell), a cell being a stretch of time. A bar
only meets windows near it, and a security with very many bars is spread over its
cells. Cells are about as wide as most windows; the few much longer windows enter
once per cell they touch, so they do not make the cells wide, and a bar is repeated
only if windows of very different lengths are both common.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns
from windowmatch.functions.times import micros
from windowmatch.operators.scan import by_time
from windowmatch.operators.tile_join import fits, tile_bars, tile_matrices
from windowmatch.staging import stage

# Spans are counted in classes, each this many times wider than the one before.
SPAN_STEP = 4
# No window touches more cells than this.
MAX_CELLS = 10_000
# A class of spans with a smaller share of the windows uses the cells of a wider one.
COMMON_SHARE = 0.1


@dataclass(frozen=True)
class Cells:
    """Cell widths as (longest span, width) in microseconds, and the range of all windows."""

    widths: tuple[tuple[int, int], ...]
    sids: tuple
    times: tuple


def cell_widths(classes: list[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    """(longest span, width) pairs for (longest span, windows) classes, both by rising span.

    Each class enters the join with at most about as many rows as there are windows.
    """
    total = sum(count for _, count in classes)
    widths: list[tuple[int, int]] = []
    waiting = 0
    for place, (span, count) in enumerate(classes):
        waiting += count
        fitting = max(span * waiting // total, span // MAX_CELLS, 1)
        if widths and fitting <= widths[-1][1]:
            widths[-1] = (span, widths[-1][1])
        elif waiting < total * COMMON_SHARE and place + 1 < len(classes):
            continue
        else:
            widths.append((span, fitting))
        waiting = 0
    return tuple(widths)


def measure(windows: DataFrame, cols: SearchColumns) -> Cells:
    """One aggregation over the windows, which returns one row per class of spans."""
    span = (micros(windows, cols.end) - micros(windows, cols.begin)).alias("_span")
    spans = windows.select(*cols.window_key, span).where("_span >= 0")
    span_class = F.floor(F.log(float(SPAN_STEP), F.col("_span") + 1.0))
    rows = (
        spans.groupBy(span_class.alias("_class"))
        .agg(
            F.max("_span").alias("span"),
            F.count(F.lit(1)).alias("n"),
            F.min(cols.sid).alias("sid_lo"),
            F.max(cols.sid).alias("sid_hi"),
            F.min(cols.begin).alias("lo"),
            F.max(cols.end).alias("hi"),
        )
        .collect()
    )
    if not rows:
        return Cells((), (), ())
    return Cells(
        cell_widths(sorted((r["span"] + 1, r["n"]) for r in rows)),
        (min(r["sid_lo"] for r in rows), max(r["sid_hi"] for r in rows)),
        (min(r["lo"] for r in rows), max(r["hi"] for r in rows)),
    )


def _cell(time: Column, width: Column) -> Column:
    return F.floor(time / width).cast("long")


def _window_cells(windows: DataFrame, cols: SearchColumns, cells: Cells) -> DataFrame:
    """The windows, once for each cell they touch."""
    begin, end = micros(windows, cols.begin), micros(windows, cols.end)
    width = F.lit(cells.widths[-1][1])
    for longest, narrower in reversed(cells.widths[:-1]):
        width = F.when(end - begin < longest, F.lit(narrower)).otherwise(width)
    timed = windows.where(F.col(cols.end) >= F.col(cols.begin)).select(
        "*", width.cast("long").alias("_width"), begin.alias("_begin"), end.alias("_end")
    )
    touched = F.sequence(*(_cell(F.col(c), F.col("_width")) for c in ("_begin", "_end")))
    return timed.select(*windows.columns, "_width", F.explode(touched).alias("_cell"))


def _bar_cells(bars: DataFrame, cols: SearchColumns, cells: Cells) -> DataFrame:
    """The bars in reach of any window, once for each cell width in use."""
    near = by_time(bars, cols, *cells.times).where(F.col(cols.sid).between(*(F.lit(v) for v in cells.sids)))
    timed = near.withColumn("_time", micros(near, cols.time))
    widths = [F.lit(width).cast("long") for _, width in cells.widths]
    width = widths[0] if len(widths) == 1 else F.explode(F.array(*widths))
    wide = timed.withColumn("_width", width)
    return wide.withColumn("_cell", _cell(F.col("_time"), F.col("_width"))).drop("_time")


def matched_bars(
    bars: DataFrame, windows: DataFrame, cols: SearchColumns, grouped: bool = False
) -> DataFrame:
    """One row per (window, bar inside it); windows without bars have no row.

    Spark picks the join from the sizes of the two sides, and splits a cell that is
    still too large when it runs. ``grouped`` is the plan for windows of few securities: it drops the
    bars of all others before they are shuffled.
    """
    cells = measure(windows, cols)
    if cells.widths:
        bars = by_time(bars, cols, *cells.times)
    bars = bars.select(*dict.fromkeys((cols.sid, *cols.time_order(bars), *cols.match)))
    fields = [c for c in bars.columns if c != cols.sid]
    if not cells.widths:
        return windows.join(bars, cols.sid).where("false")
    left = _window_cells(windows, cols, cells)
    if grouped:
        bars = bars.join(windows.select(cols.sid).distinct(), cols.sid, "left_semi")
    right = _bar_cells(bars, cols, cells)
    return (
        right.join(left, [cols.sid, "_width", "_cell"])
        .where(F.col(cols.time).between(F.col(cols.begin), F.col(cols.end)))
        .select(*windows.columns, *fields)
    )


def window_bars(
    bars: DataFrame, windows: DataFrame, cols: SearchColumns, grouped: bool = False
) -> DataFrame:
    """All windows with the bars they cover; a window without bars stays, with NULL bars.

    The matches are found once and staged, with the bars in the tasks that found them: a window may
    cover any number of bars. Only the keys of the matches are looked at again, for the windows
    without any. In a laid-out table all is done in the tiles, and ``grouped`` makes no difference.
    """
    windows = windows.select(*(c for c in (*cols.window_key, cols.period) if c in windows.columns))
    if fits(bars, windows, cols):
        return tile_bars(bars, windows, cols)
    found = stage(matched_bars(bars, windows, cols, grouped), "matches")
    keys = found.select(*cols.window_key).distinct()
    empty = windows.join(keys, [*cols.window_key], "left_anti")
    return found.unionByName(empty.select(*windows.columns), allowMissingColumns=True)


def window_matrices(
    bars: DataFrame, windows: DataFrame, cols: SearchColumns, n: int, grouped: bool = False
) -> DataFrame:
    """The bars of each window with exactly ``n`` bars, as one array in time order.

    No more than ``n + 1`` bars per window leave the task that found them: that many
    already show that a window has too many, so a window over a huge stretch of bars
    costs no more than any other. In a laid-out table the arrays are read off the tiles, no bar leaves its
    own, and ``grouped`` makes no difference.
    """
    order = cols.time_order(bars)
    keys = windows.select(*cols.window_key).distinct()
    if fits(bars, keys, cols, n):
        return tile_matrices(bars, keys, cols, n)
    pairs = matched_bars(bars, keys, cols, grouped)
    by_time = Window.partitionBy(*cols.window_key).orderBy(*order)
    entry = F.struct(*(F.col(c) for c in (*order, *cols.match)))
    return (
        pairs.withColumn("_place", F.row_number().over(by_time))
        .where(F.col("_place") <= n + 1)
        .groupBy(*cols.window_key)
        .agg(F.sort_array(F.collect_list(entry)).alias("bars"))
        .where(F.size("bars") == n)
    )
