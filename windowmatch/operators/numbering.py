"""Places of rows in an order, without one task that sorts them all.

Both functions cut the order into ranges that lie in tasks of their own, count the rows of each
range, and add the counts of the earlier ranges to the place inside the range. Only the counts, one
per range and group that crosses a border of ranges, pass through a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmatch.staging import fresh_table

# Rows of a hash range, about: few enough to be put in order in the memory of a task.
RANGE_ROWS = 1_000_000
# Fixed value: 13 hex digits of a hash are a whole number below 2^52.
HASH_DIGITS = 13

_PART, _RANGE = "_part", "_range"


def hash_number(keys: Sequence[Column], seed: int) -> Column:
    """A whole number below 2^52 that depends on the keys and the seed only; NULL is a key of its own."""
    cells = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    text = F.concat_ws("|", *cells, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def shuffled(rows: DataFrame, keys: Sequence[Column | str], seed: int = 0, name: str = "place") -> DataFrame:
    """All rows with their places, from 0 on, in a random permutation that depends on the seed only.

    ``keys`` name a row, so that the same table gives the same permutation however it is stored. Rows
    are dealt to ranges of a hash of their keys; the hash spreads any keys evenly, so no range is much
    larger than the others. Rows with equal keys are neighbours, in any order.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    width = -(-(16**HASH_DIGITS) // ranges)
    dealt = rows.withColumn("_hash", hash_number(columns, seed))
    dealt = dealt.withColumn(_RANGE, F.floor(F.col("_hash") / width).cast("long"))
    earlier = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    counts = dealt.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(_RANGE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(_RANGE).orderBy("_hash", *columns)
    return (
        dealt.withColumn("_place", F.row_number().over(within) - 1)
        .join(starts, _RANGE)
        .select(*rows.columns, (F.col("_start") + F.col("_place")).cast("long").alias(name))
    )


def numbered(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "place", parts: int | None = None
) -> DataFrame:
    """All rows with their places, from 0 on, in the order of their group; NULL is a group, and comes first.

    The rows are written once, in ranges of (group, order). A group that holds most rows is many
    ranges; rows that agree in all of ``order`` share a range, so end it with columns that tell rows
    apart. The written table is in the scratch namespace until it is released.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = fresh_table(spark, "ordered")
    (
        rows.repartitionByRange(parts, *group, *order)
        .withColumn(_PART, F.spark_partition_id())
        .write.format("parquet")
        .bucketBy(parts, _PART)
        .sortBy(*group, *order)
        .saveAsTable(table)
    )
    written = spark.table(table)
    within = Window.partitionBy(_PART, *group).orderBy(*order)
    placed = written.withColumn("_place", F.row_number().over(within) - 1)
    counts = written.groupBy(_PART, *group).agg(F.count(F.lit(1)).alias("_n"))
    if group:
        # A group that crosses a border is the first or the last of a part: two at most for each part.
        key = F.struct(*group)
        ends = written.groupBy(_PART).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        each = ends.select(_PART, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("key"))
        crossing = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key.*")
        counts = counts.join(crossing.toDF(*(f"_{g}" for g in group)), _same(group), "left_semi")
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col(_PART).alias(f"_{_PART}"), *(F.col(g).alias(f"_{g}") for g in group),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    place = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_place")
    return placed.join(before, _same([_PART, *group]), "left").select(*rows.columns, place.cast("long").alias(name))


def _same(names: Sequence[str]) -> Column:
    """Equality with columns of the same names behind an underscore, NULL with NULL."""
    return reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names))
