"""Keyed upsert and union of bars."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """One row per key: the last by ``seq``, the larger values where that is equal.

    A maximum, so copies of a key are reduced before the shuffle.
    """
    values = [c for c in rows.columns if c not in keys and c != seq]
    rank = F.struct(*([F.col(seq)] if seq else []), *(F.col(c) for c in values))
    best = rows.groupBy(*keys).agg(F.max(rank).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in values))


def upsert(
    base: DataFrame, delta: DataFrame, keys: Sequence[str], seq: str | None = None
) -> DataFrame:
    """``base`` with the rows of ``delta`` written over it; ``base`` holds each key once.

    ``seq`` orders several writes of one key inside ``delta``. Stored rows are only
    tested for a newer version and otherwise stay where they are.
    """
    fresh = latest(delta, keys, seq)
    kept = base.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*base.columns))


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, matched by column name; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
