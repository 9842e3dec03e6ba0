"""Score windows against one pattern."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowmatch.config import SearchColumns
from windowmatch.functions import kernel
from windowmatch.operators.layout import with_halo
from windowmatch.operators.range_join import window_matrices
from windowmatch.operators.tile_join import fits, tile_scores
from windowmatch.operators.series import (
    FIRST,
    LAST,
    border_runs,
    places,
    run_bars,
    with_edges,
)

Matrix = Sequence[Sequence[float]]


def score_windows(
    filled: DataFrame,
    pattern: Matrix,
    cols: SearchColumns,
    normalize: str = "mean",
    passes: int = 2,
) -> DataFrame:
    """(window key, similarity) for rows that hold the bars of their window in ``bars``."""
    score = kernel.score(F.col("bars"), pattern, cols.match, normalize, passes)
    return filled.select(*cols.window_key, score.alias("similarity"))


def similarity(
    bars: DataFrame,
    windows: DataFrame,
    pattern: Matrix,
    cols: SearchColumns = SearchColumns(),
    normalize: str = "mean",
    passes: int = 2,
    grouped: bool = False,
) -> DataFrame:
    """The distance correlation of each window with ``pattern`` (one row of prices per bar).

    Every row of ``windows`` comes back, with NULL where the score is undefined.
    ``passes=2`` measures distances between the rows of the distance matrix;
    ``passes=1`` is the textbook distance correlation. The bars of a laid-out table stay in their tiles, where
    the windows are scored off them; for other bars ``grouped`` drops the securities without a window
    before the join.
    """
    n = len(pattern)
    if fits(bars, windows, cols, n):
        scorer = kernel.scorer(pattern, cols.match, normalize, passes)
        return tile_scores(bars, windows.select(*cols.window_key), cols, n, "similarity", scorer)
    filled = window_matrices(bars, windows, cols, len(pattern), grouped)
    scored = score_windows(filled, pattern, cols, normalize, passes)
    return windows.select(*cols.window_key).join(scored, [*cols.window_key], "left")


def similarity_of_all(
    bars: DataFrame,
    pattern: Matrix,
    cols: SearchColumns = SearchColumns(),
    normalize: str = "mean",
    passes: int = 2,
) -> DataFrame:
    """Score every window of the pattern's length in a laid-out table.

    The windows overlap, so they are read off the ordered bars: nothing is joined, and
    a bar is not copied once per window. Only windows across a tile border that reach further than
    the border table are put together as arrays.
    """
    n = len(pattern)
    options = {"normalize": normalize, "passes": passes}
    wide = with_halo(bars, cols, n)
    placed = places(with_edges(bars if wide is None else wide, cols), cols, "_place")
    inside = kernel.score_runs(placed, "_place", FIRST, LAST, pattern, cols, **options)
    if wide is not None:
        return inside
    across = border_runs(bars, cols, n, {"bars": run_bars(cols, n)})
    return inside.unionByName(score_windows(across, pattern, cols, **options))


def similarity_grouped(
    bars: DataFrame,
    windows: DataFrame,
    pattern: Matrix,
    cols: SearchColumns = SearchColumns(),
    **options,
) -> DataFrame:
    """``similarity`` by the plan for windows of few securities."""
    return similarity(bars, windows, pattern, cols, grouped=True, **options)


def similarity_in_order(
    bars: DataFrame,
    samples: DataFrame,
    pattern: Matrix,
    cols: SearchColumns = SearchColumns(),
    place: str = "sample_id",
    normalize: str = "mean",
    passes: int = 2,
) -> DataFrame:
    """(place, window key, similarity) of every sample, the rows in the order of their places.

    The places go through the join with their windows, and the rows are put in order by ranges of them,
    so no list of samples ever is in one task or on the driver.
    """
    n, key = len(pattern), list(cols.window_key)
    samples = samples.select(place, *key)
    if fits(bars, samples, cols, n):
        scorer = kernel.scorer(pattern, cols.match, normalize, passes)
        scored = tile_scores(bars, samples, cols, n, "similarity", scorer)
    else:
        distinct = samples.select(*key).distinct()
        found = similarity(bars, distinct, pattern, cols, normalize, passes).withColumnsRenamed({c: f"_{c}" for c in key})
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
        scored = samples.join(found, same, "left").select(*samples.columns, "similarity")
    return scored.orderBy(place)


def similarities(
    bars: DataFrame,
    samples: Sequence[tuple],
    pattern: Matrix,
    cols: SearchColumns = SearchColumns(),
    **options,
) -> list[float | None]:
    """Scores of windows the caller lists as (sid, begin, end), in the order of the list."""
    sid, time = bars.schema[cols.sid].dataType, bars.schema[cols.time].dataType
    schema = T.StructType(
        [
            T.StructField(cols.sid, sid),
            T.StructField(cols.begin, time),
            T.StructField(cols.end, time),
            T.StructField("_sample", T.LongType()),
        ]
    )
    listed = bars.sparkSession.createDataFrame([(*s, i) for i, s in enumerate(samples)], schema)
    scored = similarity_in_order(bars, listed, pattern, cols, "_sample", **options)
    return [row["similarity"] for row in scored.select("similarity").collect()]
