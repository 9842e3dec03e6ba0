"""Windows matched with the bars they cover where the bars lie: in the tiles of a laid-out table.

The border table says which bars a tile holds, so each window is sent to its tiles, and no bar moves. In
a tile the bars are an index: sorted by security and time, they are read once, and the windows, which
follow in Arrow batches, find their first and last bar by binary search.

Three things are done with a match. ``tile_bars`` gives every bar: a window goes to all tiles it overlaps, and
what it covers of one is found there. ``tile_scores`` scores the bars of whole windows, ``tile_matrices`` lists
them: a window goes to the tile with its first bar alone, which also knows the bars behind its border.

A task holds the bars of one tile; windows pass by in batches, however many they are.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowmatch.config import SearchColumns
from windowmatch.functions.times import micros
from windowmatch.operators.layout import TILE, Borders, beside, borders, with_halo
from windowmatch.operators.scan import by_time

# Executors get these functions with the task and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of matches in one Arrow batch.
CHUNK = 100_000

KIND, FROM, TO, NEW = "_kind", "_from", "_to", "_new"


class Ranks:
    """Places of (security, time) pairs in an ascending list of them, by one integer key a pair."""

    def __init__(self, sids: pa.Array, times: np.ndarray):
        self.sids = pc.unique(sids)
        self.times = np.unique(times)
        self.step = len(self.times) + 1
        own = pc.index_in(sids, self.sids).to_numpy(zero_copy_only=False)
        self.keys = own.astype(np.int64) * self.step + np.searchsorted(self.times, times)

    def _known(self, sids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = pc.index_in(sids, self.sids)
        valid = pc.is_valid(found).to_numpy(zero_copy_only=False)
        return pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64), valid

    def spans(self, sids: pa.Array, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of the pairs of a security in a closed range of time."""
        own, valid = self._known(sids)
        first = np.searchsorted(self.keys, own * self.step + np.searchsorted(self.times, begin, "left"))
        stop = np.searchsorted(self.keys, own * self.step + np.searchsorted(self.times, end, "right"))
        return first, np.where(valid, np.maximum(stop - first, 0), 0)


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False)


def _before(sids: np.ndarray, times: np.ndarray, sid: np.ndarray, time: np.ndarray, side: str) -> np.ndarray:
    """How many of the ascending pairs (sids, times) lie before each pair, or up to it (``side`` right)."""
    some = np.unique(sids)
    place = np.searchsorted(some, sid)
    present = some[np.minimum(place, len(some) - 1)] == sid
    ticks = np.unique(times)
    step = len(ticks) + 1
    keys = np.searchsorted(some, sids) * step + np.searchsorted(ticks, times)
    rank = np.searchsorted(ticks, time, side)
    return np.searchsorted(keys, place * step + np.where(present, rank, 0))


def route(windows: DataFrame, cols: SearchColumns, known: Borders, overlap: bool) -> DataFrame:
    """The windows with their tile, and their begin and end as numbers.

    The tile is that of the first bar at or after the begin; with ``overlap``, a window is repeated for
    every tile up to that of its last bar, and the first one is marked. One row per tile comes to the
    driver and goes to every task: sids and times of the bounds.
    """
    ends = known.rows.select(
        TILE, F.col("lo.sid").alias("a"), F.col("hi.sid").alias("b"), F.col("lo.time").alias("c"), F.col("hi.time").alias("d")
    )
    ends = ends.select(TILE, "a", "b", micros(ends, "c").alias("c"), micros(ends, "d").alias("d")).orderBy(TILE).toPandas()
    bounds = windows.sparkSession.sparkContext.broadcast({c: ends[c].to_numpy() for c in ends.columns})

    @F.arrow_udf("struct<first: int, last: int>")
    def tiles(sid: pa.Array, begin: pa.Array, end: pa.Array) -> pa.Array:
        known = bounds.value
        sids, most = _numbers(sid), len(known[TILE]) - 1
        first = np.minimum(_before(known["b"], known["d"], sids, _numbers(begin), "left"), most)
        last = np.maximum(_before(known["a"], known["c"], sids, _numbers(end), "right") - 1, first)
        return pa.StructArray.from_arrays(
            [pa.array(known[TILE][i].astype(np.int32)) for i in (first, last)], names=["first", "last"]
        )

    timed = windows.withColumn(FROM, micros(windows, cols.begin)).withColumn(TO, micros(windows, cols.end))
    found = timed.withColumn("_tiles", tiles(F.col(cols.sid), F.col(FROM), F.col(TO)))
    if not overlap:
        return found.withColumn(TILE, F.col("_tiles.first")).drop("_tiles")
    every = F.explode(F.sequence(F.col("_tiles.first"), F.col("_tiles.last")))
    return found.withColumn(TILE, every).withColumn(NEW, F.col(TILE) == F.col("_tiles.first")).drop("_tiles")


def fits(bars: DataFrame, windows: DataFrame, cols: SearchColumns, n: int = 0) -> bool:
    """Whether the tiles can be used: borders known ``n`` bars far, whole numbers for securities, some bars."""
    known = borders(bars)
    whole = isinstance(bars.schema[cols.sid].dataType, T.IntegralType)
    whole = whole and isinstance(windows.schema[cols.sid].dataType, T.IntegralType)
    return bool(known and whole and n <= known.reach and known.rows.limit(1).count())


def _met(bars: DataFrame, routed: DataFrame, cols: SearchColumns) -> tuple[DataFrame, list[str]]:
    """The bars in reach of any window of their tile beside the windows, and the order they are wanted in."""
    envelope = routed.groupBy(TILE).agg(
        F.min(cols.sid).alias("_s0"), F.max(cols.sid).alias("_s1"), F.min(FROM).alias("_t0"), F.max(TO).alias("_t1")
    )
    bars = bars.withColumn(FROM, micros(bars, cols.time)).withColumnRenamed(cols.sid, "_bar_sid")
    near = F.col("_bar_sid").between(F.col("_s0"), F.col("_s1")) & F.col(FROM).between(F.col("_t0"), F.col("_t1"))
    bars = bars.join(envelope.hint("shuffle_hash"), TILE).where(near).drop("_s0", "_s1", "_t0", "_t1")
    bars = bars.withColumnRenamed("_bar_sid", cols.sid).withColumn(KIND, F.lit(0))
    order = [c for c in (cols.sid, FROM, cols.exchange) if c in bars.columns]
    return beside(bars, routed.withColumn(KIND, F.lit(1))), [TILE, KIND, *order]


Matched = Callable[[pa.Table, pa.RecordBatch, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _per_tile(
    met: DataFrame, order: list[str], cols: SearchColumns, buckets: int, matched: Matched, schema: T.StructType
) -> DataFrame:
    """``matched`` gets the bars of a tile, a batch of its windows, and first place and number of their bars."""
    sid = cols.sid

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        bars = index = None
        for batch in batches:
            windows = batch.filter(pc.equal(batch.column(KIND), 1))
            if windows.num_rows < batch.num_rows:
                if index is not None:
                    raise RuntimeError("the bars of a tile must come before its windows")
                kept.append(batch.filter(pc.equal(batch.column(KIND), 0)))
            if not windows.num_rows:
                continue
            if index is None:
                # bars come first: they are complete now
                bars = pa.Table.from_batches(kept, batch.schema).combine_chunks()
                kept.clear()
                index = Ranks(bars[sid].combine_chunks(), bars[FROM].to_numpy())
            begin, end = _numbers(windows.column(FROM)), _numbers(windows.column(TO))
            first, count = index.spans(windows.column(sid), begin, end)
            valid = pc.and_(pc.is_valid(windows.column(FROM)), pc.is_valid(windows.column(TO)))
            count = np.where(valid.to_numpy(zero_copy_only=False), count, 0)
            yield from matched(bars, windows, first, count)

    found = met.sortWithinPartitions(*order).groupBy(TILE).applyInArrow(tile, schema)
    plan = found._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan.split("Union")[0]:
        # Spark would shuffle the sorted rows: then shuffle first, and sort what a task gets
        found = met.repartition(buckets, TILE).sortWithinPartitions(*order).groupBy(TILE).applyInArrow(tile, schema)
    return found


def tile_bars(bars: DataFrame, windows: DataFrame, cols: SearchColumns) -> DataFrame:
    """One row per (window, bar inside it), and one with NULLs for a window without bars."""
    fields = [c for c in dict.fromkeys((*cols.time_order(bars), *cols.match))]
    wanted = list(windows.columns)
    routed = route(windows, cols, borders(bars), overlap=True)
    routed = routed.repartition(borders(bars).buckets, TILE)
    met, order = _met(bars.select(cols.sid, TILE, *fields), routed, cols)
    kinds = {**{f.name: f for f in windows.schema}, **{f: bars.schema[f] for f in fields}}
    schema = T.StructType([T.StructField(c, kinds[c].dataType) for c in (*wanted, *fields)])

    def matched(bars: pa.Table, windows: pa.RecordBatch, first: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        empty = pa.array((count == 0) & windows.column(NEW).to_numpy(zero_copy_only=False))
        alone = windows.filter(empty)
        if alone.num_rows:
            arrays = [alone.column(c) for c in wanted] + [pa.nulls(alone.num_rows, bars.schema.field(f).type) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[*wanted, *fields])
        ends = np.cumsum(count)
        starts = ends - count
        for at in range(0, int(ends[-1]), CHUNK):
            row = np.arange(at, min(at + CHUNK, int(ends[-1])))
            window = np.searchsorted(ends, row, "right")
            bar = pa.array(first[window] + row - starts[window])
            window = pa.array(window)
            arrays = [windows.column(c).take(window) for c in wanted]
            arrays += [bars[f].combine_chunks().take(bar) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[*wanted, *fields])

    return _per_tile(met, order, cols, borders(bars).buckets, matched, schema)


def tile_scores(
    bars: DataFrame, windows: DataFrame, cols: SearchColumns, n: int, name: str, score: Callable[[np.ndarray], pa.Array]
) -> DataFrame:
    """Every window with the score of its bars, NULL for one with another number than ``n``.

    ``score`` takes (windows, bars, match columns) and gives a value for each window.
    """
    known, key = borders(bars), list(windows.columns)
    routed = route(windows, cols, known, overlap=False).repartition(known.buckets, TILE)
    own = with_halo(bars, cols, n).select(cols.sid, TILE, *dict.fromkeys((*cols.time_order(bars), *cols.match)))
    met, order = _met(own, routed, cols)
    names = list(cols.match)
    schema = T.StructType(
        [*(T.StructField(c, windows.schema[c].dataType) for c in key), T.StructField(name, T.DoubleType())]
    )

    def matched(bars: pa.Table, windows: pa.RecordBatch, first: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole = count == n
        # windows come in order: the prices of a batch are a stretch of those of the tile
        begin = first[whole] if whole.any() else np.zeros(0, np.int64)
        low, stop = (int(begin.min()), int(begin.max()) + n) if len(begin) else (0, 0)
        near = bars.slice(low, stop - low)
        prices = np.stack([pc.cast(near[c], pa.float64()).to_numpy(zero_copy_only=False) for c in names], axis=-1)
        found = score(prices[(begin - low)[:, None] + np.arange(n)])
        scores = pc.replace_with_mask(pa.nulls(len(whole), pa.float64()), pa.array(whole), found)
        yield pa.RecordBatch.from_arrays([*(windows.column(c) for c in key), scores], names=[*key, name])

    return _per_tile(met, order, cols, known.buckets, matched, schema)


def tile_matrices(bars: DataFrame, windows: DataFrame, cols: SearchColumns, n: int) -> DataFrame:
    """The bars of each window with exactly ``n`` bars, as one array in time order; other windows have no row.

    The range of all windows reaches the scan of the bars.
    """
    known, key = borders(bars), list(windows.columns)
    fields = list(dict.fromkeys((*cols.time_order(bars), *cols.match)))
    reach = windows.agg(F.min(cols.begin), F.max(cols.end)).first()
    own = with_halo(bars, cols, n).select(cols.sid, TILE, *fields)
    if None not in reach:
        own = by_time(own, cols, *reach)
    routed = route(windows, cols, known, overlap=False).repartition(known.buckets, TILE)
    met, order = _met(own, routed, cols)
    # bars of one time are put in the order of their prices
    order += [c for c in fields if c not in order]
    listed = T.ArrayType(T.StructType([bars.schema[f] for f in fields]))
    schema = T.StructType([*(T.StructField(c, windows.schema[c].dataType) for c in key), T.StructField("bars", listed)])

    def matched(bars: pa.Table, windows: pa.RecordBatch, first: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole = count == n
        place = pa.array((first[whole][:, None] + np.arange(n)).ravel())
        cells = pa.StructArray.from_arrays([bars[f].combine_chunks().take(place) for f in fields], names=fields)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cells) + 1, n, dtype=np.int32)), cells)
        found = windows.filter(pa.array(whole))
        yield pa.RecordBatch.from_arrays([*(found.column(c) for c in key), lists], names=[*key, "bars"])

    return _per_tile(met, order, cols, known.buckets, matched, schema)
