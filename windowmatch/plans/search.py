"""Pattern search: the windows most similar to one window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns
from windowmatch.operators.scan import by_sid, by_time
from windowmatch.operators.topk import top_k
from windowmatch.operators.windows import first_window
from windowmatch.plans.similarity import similarity, similarity_of_all


def pattern_matrix(
    bars: DataFrame, cols: SearchColumns, sid: int, begin, end
) -> list[list[float]]:
    """The prices of one window, a row per bar in time order. The one window goes to every task."""
    order = cols.time_order(bars)
    rows = (
        by_sid(by_time(bars, cols, begin, end), cols, sid)
        .select(*dict.fromkeys((*order, *cols.match)))
        .orderBy(*order)
        .collect()
    )
    if not rows:
        raise ValueError("the pattern window has no bars")
    return [[float("nan") if r[c] is None else float(r[c]) for c in cols.match] for r in rows]


def _is_window(cols: SearchColumns, window: Row, like: DataFrame):
    same = F.lit(True)
    for c in cols.window_key:
        same = same & (F.col(c) == F.lit(window[c]).cast(like.schema[c].dataType))
    return same


def pattern_search(
    bars: DataFrame,
    windows: DataFrame,
    cols: SearchColumns = SearchColumns(),
    k: int = 10,
    pattern: Row | None = None,
    every_window: bool = False,
    **options,
) -> DataFrame:
    """The ``k`` windows most similar to ``pattern``, by default the first of ``windows``.

    ``every_window`` states that ``windows`` are all windows of the pattern's length in
    the laid-out table ``bars``; they are then read off the bars instead of joined.
    """
    chosen = pattern or first_window(windows, cols).first()
    if chosen is None:
        raise ValueError("there are no windows")
    matrix: Sequence[Sequence[float]] = pattern_matrix(
        bars, cols, *(chosen[c] for c in cols.window_key)
    )
    if every_window:
        scored = similarity_of_all(bars, matrix, cols, **options)
        samples = scored.where(~_is_window(cols, chosen, scored))
        return top_k(samples, cols, k)
    samples = windows.where(~_is_window(cols, chosen, windows))
    return top_k(similarity(bars, samples, matrix, cols, **options), cols, k)
