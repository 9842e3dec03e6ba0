"""Distributed layout of a bars table.

Bars are range-clustered by (sid, time) into *tiles* of about equal size,
numbered in key order. A security with very many bars gets many tiles, and many
small securities share one, so no later group is larger than a tile. The table is
bucketed by tile: window functions inside a tile need no further shuffle.

Beside the bars lies a table of borders with one row per tile: its first and last bar, how many bars its
first and last security have in earlier tiles and in all, and the ``reach`` bars that follow the tile's last
one. It is bucketed like the bars, so work on a tile sees the bars behind its border where it runs.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowmatch.config import SearchColumns
from windowmatch.staging import Scratch, fresh_table

TILE = "tile"

# Several tiles per bucket even out the sizes of the buckets.
TILES_PER_BUCKET = 4
MIN_TILE_ROWS = 1_000
MAX_TILE_ROWS = 5_000_000
MAX_BUCKETS = 100_000

# Bars behind its border that a tile knows.
REACH = 64
# Marks the bars from behind the border among those of a tile.
HALO = "_halo"


@dataclass(frozen=True)
class Borders:
    """The border table of a laid-out table.

    ``rows``: tile, ``lo`` and ``hi`` (security and time of the first and the last bar), ``lo_before`` (bars of
    the first security in earlier tiles), ``lo_total`` and ``hi_total`` (all bars of the first and the
    last security, if it spans tiles), ``after`` (the bars of the last security behind the border, in order).
    """

    rows: DataFrame
    reach: int
    buckets: int


# Frames as lay_out and open_layout return them; whatever is derived from one has no borders.
_borders: WeakKeyDictionary[DataFrame, Borders] = WeakKeyDictionary()


def borders(bars: DataFrame) -> Borders | None:
    """The border table, if ``bars`` is a laid-out table itself and not a part of it."""
    return _borders.get(bars)


def tile_count(rows: int, partitions: int) -> int:
    """Enough tiles for all tasks, none very large, and none tiny just to have more."""
    wanted = min(rows // MIN_TILE_ROWS, TILES_PER_BUCKET * partitions)
    return max(wanted, -(-rows // MAX_TILE_ROWS), 1)


def lay_out(
    bars: DataFrame,
    cols: SearchColumns = SearchColumns(),
    tiles: int | None = None,
    table: str | None = None,
    reach: int = REACH,
) -> DataFrame:
    """Write ``bars`` in tiles and return the written table.

    The table is kept under the name ``table``, to be read by ``open_layout`` in any
    later session, or staged in the shared folder for this one. The number of tiles
    follows from a count of the bars unless given.
    """
    spark = bars.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles or tile_count(bars.count(), partitions)
    buckets = max(2, min(tiles, max(partitions, tiles // TILES_PER_BUCKET), MAX_BUCKETS))
    key = cols.bar_key(bars)
    name = table or fresh_table(spark, "bars")
    (
        bars.repartitionByRange(tiles, cols.sid, cols.time)
        .withColumn(TILE, F.spark_partition_id())
        .write.format("parquet")
        .bucketBy(buckets, TILE)
        .sortBy(*key)
        .saveAsTable(name)
    )
    written = spark.table(name)
    _write_borders(written, cols, f"{name}{BORDERS}" if table else fresh_table(spark, "borders"), reach, buckets)
    return written


# What the name of a border table adds to that of its bars.
BORDERS = "_borders"


def open_layout(spark: SparkSession, table: str) -> DataFrame:
    """A table that ``lay_out`` wrote under this name, with its borders."""
    bars, rows = spark.table(table), spark.table(f"{table}{BORDERS}")
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    reach = rows.agg(F.max("reach")).first()[0]
    _borders[bars] = Borders(rows.drop("reach"), reach or 0, int(described["Num Buckets"]))
    return bars


def _write_borders(bars: DataFrame, cols: SearchColumns, name: str, reach: int, buckets: int) -> None:
    """Two passes over the bars: the bounds of all tiles, then the first bars of each in split securities.

    The bounds, one row per tile, come to the driver, which finds the securities of several tiles.
    """
    spark, sid, time = bars.sparkSession, cols.sid, cols.time
    end = F.struct(F.col(sid).alias("sid"), F.col(time).alias("time"))
    bounds = bars.groupBy(TILE).agg(F.min(end).alias("lo"), F.max(end).alias("hi"))
    known = bounds.orderBy(TILE).collect()
    bounds = spark.createDataFrame(known, bounds.schema)
    tiles_of = Counter(s for r in known for s in {r["lo"]["sid"], r["hi"]["sid"]})
    split = [(s,) for s, tiles in tiles_of.items() if tiles > 1]
    split = spark.createDataFrame(split, T.StructType([T.StructField(sid, bars.schema[sid].dataType)]))
    with Scratch() as scratch:
        in_tile = Window.partitionBy(TILE, sid)
        bar = F.struct(*(F.col(c) for c in bars.columns if c not in (sid, TILE)))
        heads = (
            bars.join(split, sid, "left_semi")
            .select(
                sid, TILE, F.count(F.lit(1)).over(in_tile).alias("n"), bar.alias("bar"),
                F.row_number().over(in_tile.orderBy(*cols.time_order(bars))).alias("place"),
            )
            .where(F.col("place") <= reach)
        )
        heads = scratch.stage(heads, "heads")
        of_sid = Window.partitionBy(sid)
        earlier = of_sid.orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
        counts = heads.where("place = 1").select(
            sid, TILE, "n", F.sum("n").over(of_sid).alias("total"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        )
        # the bars behind a border lie at the ``reach`` places from its own on, in two stretches at most
        placed = heads.join(counts.select(sid, TILE, "before"), [sid, TILE])
        placed = placed.withColumn("pos", F.col("before") + F.col("place") - 1)
        stretch = F.floor(F.col("pos") / reach)
        placed = placed.select(sid, "pos", "bar", stretch.alias("stretch"))
        ends = counts.select(sid, TILE, (F.col("before") + F.col("n")).alias("end"), "total").where("end < total")
        first = F.floor(F.col("end") / reach)
        ends = ends.withColumn("stretch", F.explode(F.array(first, first + 1)))
        behind = (F.col("pos") >= F.col("end")) & (F.col("pos") < F.col("end") + reach)
        after = ends.join(placed, [sid, "stretch"]).where(behind).groupBy(sid, TILE)
        after = after.agg(F.sort_array(F.collect_list(F.struct("pos", "bar"))).alias("after"))

        def known(prefix: str) -> DataFrame:
            return counts.select(
                TILE, F.col(sid).alias(f"_{prefix}"), F.col("before").alias(f"{prefix}_before"),
                F.col("total").alias(f"{prefix}_total"),
            )

        rows = bounds
        for prefix in ("lo", "hi"):
            rows = rows.withColumn(f"_{prefix}", F.col(f"{prefix}.sid")).join(known(prefix), [TILE, f"_{prefix}"], "left")
        rows = rows.join(after.withColumnRenamed(sid, "_hi"), [TILE, "_hi"], "left").select(
            TILE, "lo", "hi", F.coalesce("lo_before", F.lit(0)).alias("lo_before"), "lo_total", "hi_total",
            F.transform("after", lambda a: a["bar"]).alias("after"), F.lit(reach).alias("reach"),
        )
        rows.repartition(buckets, TILE).write.format("parquet").bucketBy(buckets, TILE).saveAsTable(name)
    _borders[bars] = Borders(spark.table(name).drop("reach"), reach, buckets)


def _in_several(rows: DataFrame, sid: str) -> DataFrame:
    return rows.groupBy(sid).agg(F.count(F.lit(1)).alias("_tiles")).where("_tiles > 1").select(sid)


def with_halo(bars: DataFrame, cols: SearchColumns, n: int) -> DataFrame | None:
    """The bars of each tile and, marked, the ``n`` bars that follow it; None if so many are not known.

    Both tables are bucketed by tile alike, so their union is, too, and nothing moves.
    """
    known = borders(bars)
    if known is None or n > known.reach:
        return None
    next_bars = known.rows.select(
        TILE, F.col("hi.sid").alias(cols.sid), F.explode(F.slice("after", 1, n)).alias("bar")
    ).select(cols.sid, TILE, "bar.*", F.lit(True).alias(HALO))
    return beside(bars.withColumn(HALO, F.lit(False)), next_bars)


def beside(*parts: DataFrame) -> DataFrame:
    """All rows of frames that are bucketed or partitioned by tile alike; their union is, too.

    Spark sees that only for a column that belongs to none of the tables: the tile is renamed and
    gets its name back. Should it not see it, the rows are shuffled, and nothing else changes.
    """
    renamed = [p.withColumnRenamed(TILE, "_of_tile") for p in parts]
    union = renamed[0]
    for more in renamed[1:]:
        union = union.unionByName(more, allowMissingColumns=True)
    return union.withColumnRenamed("_of_tile", TILE)


def split_sids(bars: DataFrame, cols: SearchColumns) -> DataFrame:
    """Securities that continue from one tile to the next.

    Tiles are in key order, so each border splits at most one security: there are fewer
    rows here than tiles.
    """
    ends = bars.groupBy(TILE).agg(F.min(cols.sid).alias("_lo"), F.max(cols.sid).alias("_hi"))
    each = ends.select(TILE, F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias(cols.sid))
    return _in_several(each, cols.sid)
