"""The best windows of a scored set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns


def top_k(
    scored: DataFrame, cols: SearchColumns, k: int = 10, score: str = "similarity"
) -> DataFrame:
    """The ``k`` highest scores; of equal ones the later window. Undefined scores are out."""
    best = [F.desc(score), *(F.desc(c) for c in cols.window_key)]
    defined = scored.where(F.col(score).isNotNull() & ~F.isnan(score))
    hits = defined.orderBy(*best).limit(k)
    # Only k rows are left to number.
    rank = F.row_number().over(Window.orderBy(*best)).alias("rank")
    return hits.select(rank, score, *cols.window_key)
