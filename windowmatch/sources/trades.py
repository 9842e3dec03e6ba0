"""Bars derived from single trades, where no bars table exists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bars_from_trades(
    trades: DataFrame,
    sid: Column,
    time: Column,
    price: Column,
    quantity: Column,
    order: Sequence[str],
    unit: str = "day",
) -> DataFrame:
    """One bar per security and time unit; ``order`` decides the first and the last trade."""
    rows = trades.select(
        sid.alias("sid"),
        F.date_trunc(unit, time).cast("timestamp_ntz").alias("datetime"),
        price.alias("p"),
        quantity.alias("q"),
        F.struct(*order).alias("at"),
    )
    return rows.groupBy("sid", "datetime").agg(
        F.min_by("p", "at").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "at").alias("close"),
        F.sum("q").alias("volume"),
    )
