"""Operators on the ordered bars of a security, over a laid-out table.

Work inside a tile needs no shuffle. What crosses tile borders is read off the border table of
the layout, where the tile lies; for runs longer than its reach, or frames without borders, it is brought
together from the ``n - 1`` bars next to each border only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns
from windowmatch.operators.layout import HALO, TILE, borders, split_sids, with_halo

FIRST, LAST = "_first", "_last"

Over = Callable[[WindowSpec], Column]


def _start(cols: SearchColumns) -> list[Column]:
    return [F.col(cols.sid), F.col(cols.time).alias(cols.begin), F.col(TILE)]


def _run_columns(
    cols: SearchColumns, n: int, over: WindowSpec, extra: dict[str, Over] | None
) -> list[Column]:
    end = F.lead(cols.time, n - 1).over(over) if n > 1 else F.col(cols.time)
    more = (make(over).alias(name) for name, make in (extra or {}).items())
    return [end.alias(cols.end), *more]


def with_edges(bars: DataFrame, cols: SearchColumns) -> DataFrame:
    """Flags the first and the last bar of each (sid, time): two only with several exchanges.

    Bars of one security and time are always in one tile. No run starts at a bar from behind the border.
    """
    own = ~F.col(HALO) if HALO in bars.columns else F.lit(True)
    if cols.exchange not in bars.columns:
        return bars.select("*", own.alias(FIRST), F.lit(True).alias(LAST))
    in_tile = Window.partitionBy(TILE, cols.sid).orderBy(*cols.time_order(bars))
    time = F.col(cols.time)
    before, after = F.lag(cols.time).over(in_tile), F.lead(cols.time).over(in_tile)
    first, last = ~before.eqNullSafe(time), ~after.eqNullSafe(time)
    return bars.select("*", (own & first).alias(FIRST), last.alias(LAST))


def border_runs(
    bars: DataFrame, cols: SearchColumns, n: int, extra: dict[str, Over] | None = None
) -> DataFrame:
    """The runs of ``n`` bars that begin in one tile and end in a later one.

    Only the ``n - 1`` bars on either side of a border are brought together, in stretches of at most
    ``2 (n - 1)`` places of a security: every border bar goes to the stretch it lies in, and to the one
    before, whose runs may reach it. So a security that spans very many tiles is many groups.
    """
    order = cols.time_order(bars)
    in_tile = Window.partitionBy(cols.sid, TILE).orderBy(*order)
    across = Window.partitionBy(cols.sid, "_stretch").orderBy("_pos")
    # Runs of one bar end where they begin: no bar is a tail then.
    is_tail = F.lead(cols.time, n - 1).over(in_tile).isNull() if n > 1 else F.lit(False)
    spanning = with_edges(bars.join(split_sids(bars, cols), cols.sid, "left_semi"), cols)
    border = (
        spanning.select("*", is_tail.alias("_is_tail"), F.row_number().over(in_tile).alias("_from_start"))
        .where(F.col("_is_tail") | (F.col("_from_start") < n))
        .join(split_counts(bars, cols).select(cols.sid, TILE, "_n_before"), [cols.sid, TILE])
        .withColumn("_pos", F.col("_n_before") + F.col("_from_start") - 1)
    )
    own = F.floor(F.col("_pos") / max(n - 1, 1))
    dealt = border.withColumn("_own", own).withColumn("_stretch", F.explode(F.array(own, own - 1)))
    starts_here = F.col("_is_tail") & F.col(FIRST) & (F.col("_own") == F.col("_stretch"))
    return (
        dealt.select(*_start(cols), starts_here.alias("_starts"), *_run_columns(cols, n, across, extra))
        .where(F.col("_starts") & F.col(cols.end).isNotNull())
        .drop("_starts")
    )


def runs(
    bars: DataFrame, cols: SearchColumns, n: int, extra: dict[str, Over] | None = None
) -> DataFrame:
    """One row per run of ``n`` consecutive bars of a security: all its windows.

    Where several exchanges have a bar at one time, one run starts there. Gives the window
    key, ``period``, the tile of the first bar, and the ``extra`` columns, each a function of a window specification whose rows are the bars of one
    security from the current bar on.
    """
    if n < 1:
        raise ValueError("a window has at least one bar")
    in_tile = Window.partitionBy(TILE, cols.sid).orderBy(*cols.time_order(bars))
    wide = with_halo(bars, cols, n)
    inside = with_edges(bars if wide is None else wide, cols).select(
        *_start(cols), FIRST, *_run_columns(cols, n, in_tile, extra)
    )
    found = inside.where(F.col(FIRST) & F.col(cols.end).isNotNull()).drop(FIRST)
    if n > 1 and wide is None:
        found = found.unionByName(border_runs(bars, cols, n, extra))
    return found.withColumn(cols.period, F.lit(n))


def places(bars: DataFrame, cols: SearchColumns, name: str) -> DataFrame:
    """Number the bars of each (sid, tile) from 1 on; the rows come in that order."""
    in_tile = Window.partitionBy(TILE, cols.sid).orderBy(*cols.time_order(bars))
    return bars.withColumn(name, F.row_number().over(in_tile))


def run_bars(cols: SearchColumns, n: int) -> Over:
    """The prices of a run as an array in time order, for ``runs``.

    NULL if another exchange has one more bar at the end time: the window covers more
    than ``n`` bars then.
    """
    prices = F.struct(*(F.col(c) for c in cols.match))

    def bars(over: WindowSpec) -> Column:
        whole = F.lead(LAST, n - 1).over(over) if n > 1 else F.col(LAST)
        return F.when(whole, F.collect_list(prices).over(over.rowsBetween(0, n - 1)))

    return bars


def split_counts(bars: DataFrame, cols: SearchColumns) -> DataFrame:
    """For the securities that span tiles: bars in all, and bars before each tile.

    At most two rows per tile.
    """
    per_sid = Window.partitionBy(cols.sid)
    before = per_sid.orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    return (
        bars.join(split_sids(bars, cols), cols.sid, "left_semi")
        .groupBy(cols.sid, TILE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            cols.sid,
            TILE,
            F.sum("_n").over(per_sid).alias("_n_sid"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        )
    )


def positions(bars: DataFrame, cols: SearchColumns) -> DataFrame:
    """The ordered sequence of each security: rows numbered from 0 on in ``pos``."""
    numbered = places(bars, cols, "_place")
    known = borders(bars)
    if known:
        before = known.rows.select(TILE, F.col("lo.sid").alias("_lo"), "lo_before")
        earlier = F.when(F.col(cols.sid) == F.col("_lo"), F.col("lo_before")).otherwise(0)
        return numbered.join(before, TILE).select(*bars.columns, (earlier + F.col("_place") - 1).alias("pos"))
    before = split_counts(bars, cols).select(cols.sid, TILE, "_n_before")
    return (
        numbered.join(before, [cols.sid, TILE], "left")
        .withColumn("pos", F.coalesce(F.col("_n_before"), F.lit(0)) + F.col("_place") - 1)
        .drop("_place", "_n_before")
    )


def starts(bars: DataFrame, cols: SearchColumns, n: int) -> DataFrame:
    """All windows of ``n`` bars with the length of their series in ``n_bars``."""
    known = borders(bars)

    def in_tile(over: WindowSpec) -> Column:
        own = F.when(~F.col(HALO), 1) if known and n <= known.reach else F.lit(1)
        return F.count(own).over(Window.partitionBy(TILE, cols.sid))

    found = runs(bars, cols, n, {"_n_tile": in_tile})
    if known:
        of_tile = known.rows.select(
            TILE, F.col("lo.sid").alias("_lo"), "lo_total", F.col("hi.sid").alias("_hi"), "hi_total"
        )
        sid = F.col(cols.sid)
        total = F.when(sid == F.col("_lo"), F.col("lo_total")).when(sid == F.col("_hi"), F.col("hi_total"))
        found = found.join(of_tile, TILE).withColumn("n_bars", F.coalesce(total, F.col("_n_tile")))
        return found.drop("_n_tile", "_lo", "lo_total", "_hi", "hi_total")
    return (
        found.join(split_counts(bars, cols), [cols.sid, TILE], "left")
        .withColumn("n_bars", F.coalesce(F.col("_n_sid"), F.col("_n_tile")))
        .drop("_n_tile", "_n_before", "_n_sid")
    )


def with_index(rows: DataFrame, cols: SearchColumns, name: str = "sample_id") -> DataFrame:
    """Number windows that carry their tile from 0 in (sid, begin) order.

    Tiles are in key order: the number is the windows of earlier tiles plus the place in
    the own tile. Only one count per tile passes through a single task.
    """
    in_tile = Window.partitionBy(TILE).orderBy(*cols.window_key)
    earlier = Window.orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(TILE).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(TILE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    return (
        rows.withColumn("_place", F.row_number().over(in_tile) - 1)
        .join(starts, TILE)
        .withColumn(name, (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_place", "_start")
    )
