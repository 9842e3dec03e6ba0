"""Windows of n consecutive bars: enumeration, random draw, pattern and samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns
from windowmatch.functions.times import micros
from windowmatch.operators.numbering import HASH_DIGITS, hash_number
from windowmatch.operators.series import runs, starts
from windowmatch.staging import stage

# Classes of the draws; at most so many counts come to the driver.
DRAW_CLASSES = 10_000

# Standard deviations that the cutoff of a draw lies above the number of windows wanted.
CUTOFF_SIGMAS = 8


def all_windows(bars: DataFrame, cols: SearchColumns, n: int) -> DataFrame:
    """Every window of ``n`` consecutive bars of a laid-out table."""
    return runs(bars, cols, n).select(*cols.window_key, cols.period)


def hash_uniform(rows: DataFrame, cols: SearchColumns, seed: int) -> Column:
    """A number in (0, 1) that depends on the window start and the seed only."""
    whole = hash_number([F.col(cols.sid), micros(rows, cols.begin)], seed)
    return (whole + F.lit(0.5)) / F.lit(float(16**HASH_DIGITS))


def draw_windows(
    bars: DataFrame, cols: SearchColumns, n: int, m: int, seed: int = 0
) -> DataFrame:
    """Draw ``min(m, available)`` distinct windows of ``n`` bars at random.

    A security is as likely as it has bars, then every start inside it is equally
    likely, and a repeated window is drawn again. That is successive sampling with
    weight ``bars / (bars - n + 1)`` per window, which equals taking the m smallest
    ``-ln(u) / weight`` (Efraimidis and Spirakis 2006).

    Draws below a cutoff that a few more than m are expected to pass are written once; should fewer
    pass, all of them are. One histogram of them tells how many there are, and in which of
    ``DRAW_CLASSES`` classes the m-th lies: those below it are taken where they are, and only the class
    itself is put in order.
    """
    found = starts(bars, cols, n)
    weight = F.col("n_bars") / (F.col("n_bars") - (n - 1))
    keyed = found.select(
        *cols.window_key, cols.period, (-F.ln(hash_uniform(found, cols, seed)) / weight).alias("_draw")
    )
    lengths = bars.groupBy(cols.sid).agg(F.count(F.lit(1)).alias("n"))
    free = F.greatest(F.col("n") - (n - 1), F.lit(0))
    available = lengths.agg(F.coalesce(F.sum(free), F.lit(0))).first()[0]
    share = (m + CUTOFF_SIGMAS * math.sqrt(m)) / max(available, 1)
    # Weights are at least 1, so a draw passes at least as often as -ln(u) does; the largest -ln(u) is below 37.
    for cutoff in (-math.log1p(-share), 37.0) if share < 1 else (37.0,):
        passed = stage(keyed.where(F.col("_draw") <= cutoff) if cutoff < 37 else keyed, "draws")
        place = F.floor(F.col("_draw") / F.lit(cutoff) * DRAW_CLASSES)
        classes = sorted(passed.groupBy(place.alias("c")).count().collect())
        if sum(count for _, count in classes) >= m:
            break
    below, cut = 0, 0
    for cut, count in classes:
        if below + count >= m:
            break
        below += count
    else:
        return passed.drop("_draw")
    last = passed.where(place == cut).orderBy("_draw", *cols.window_key).limit(m - below)
    return passed.where(place < cut).unionByName(last).drop("_draw")


def first_window(windows: DataFrame, cols: SearchColumns) -> DataFrame:
    """The first window in key order; the pattern unless another is given."""
    return windows.orderBy(*cols.window_key).limit(1)


def split_pattern(windows: DataFrame, cols: SearchColumns) -> tuple[DataFrame, DataFrame]:
    """The first window, and all the others."""
    head = first_window(windows, cols)
    tail = windows.join(F.broadcast(head.select(*cols.window_key)), [*cols.window_key], "left_anti")
    return head, tail
