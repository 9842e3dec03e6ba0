"""Best-fit packing of tokenised texts by large-item matching.

How full the bins get depends on the lengths only, and there are at most as many lengths as a bin
has places. So the plan is made for a histogram of the lengths, whatever the number of documents:

1. lengths above one third of the capacity meet at most twice in a bin: from the longest down, each
   is matched with the longest other one that still fits beside it;
2. shorter lengths, from the longest down, go to the fullest bins with a gap of at least that length,
   as many to a bin as fit; what finds no gap opens bins of its own.

A plan entry says where the pieces of one length with ranks from ``first`` on go: ``each`` to a bin,
from bin ``bin`` and place ``offset`` on. Pieces are ranked within their length by Spark, over a salt,
so that a length that a third of all pieces share is no single task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmatch.llm.shared import Staged, crc
from windowmatch.llm.tokens import encoder

CAPACITY = 2048
END = 0
#: Pieces of one length in one group while ranking, about.
GROUP = 200_000


@dataclass(frozen=True)
class Entry:
    """Pieces of ``length`` with ranks in [first, first + count): ``each`` to a bin."""

    length: int
    first: int
    count: int
    bin: int
    each: int
    offset: int


class _Gaps:
    """Groups of equally filled bins (first bin, number) by gap."""

    def __init__(self):
        self.sizes: list[int] = []
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.groups:
                bisect.insort(self.sizes, gap)
                self.groups[gap] = []
            self.groups[gap].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A group with the smallest gap of at least ``least``."""
        at = bisect.bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap]
            self.sizes.pop(at)
        return gap, first, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Entry]:
    """Where the pieces go, for a number of pieces by length. Lengths run from 1 to ``capacity``."""
    entries: list[Entry] = []
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    gaps, bins = _Gaps(), 0

    def put(length: int, count: int, first_bin: int, each: int, offset: int) -> None:
        entries.append(Entry(length, used[length], count, first_bin, each, offset))
        used[length] += count
        left[length] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        at = bisect.bisect_right(large, capacity - longest) - 1
        partner = large[at] if at >= 0 else None
        if partner == longest and left[longest] == 1:
            partner = large[at - 1] if at > 0 else None
        if partner is None:
            count = left[longest]
            put(longest, count, bins, 1, 0)
            gaps.add(capacity - longest, bins, count)
        elif partner == longest:
            count = left[longest] // 2
            put(longest, 2 * count, bins, 2, 0)
            gaps.add(capacity - 2 * longest, bins, count)
        else:
            count = min(left[longest], left[partner])
            put(longest, count, bins, 1, 0)
            put(partner, count, bins, 1, longest)
            gaps.add(capacity - longest - partner, bins, count)
        bins += count
        large = [n for n in large if left[n]]
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            group = gaps.take(length)
            if group is None:
                each = capacity // length
                group = (capacity, bins, -(-left[length] // each))
                bins += group[2]
            gap, first, count = group
            each = gap // length
            full = min(count, left[length] // each)
            if full:
                put(length, full * each, first, each, capacity - gap)
                gaps.add(gap - each * length, first, full)
            if full < count:
                rest = left[length]
                if 0 < rest < each:
                    put(length, rest, first + full, rest, capacity - gap)
                    gaps.add(gap - rest * length, first + full, 1)
                    full += 1
                gaps.add(gap, first + full, count - full)
    return entries


def _places(entries: list[Entry]) -> dict[int, np.ndarray]:
    by_length: dict[int, list[Entry]] = {}
    for e in entries:
        by_length.setdefault(e.length, []).append(e)
    return {
        n: np.array([(e.first, e.bin, e.each, e.offset) for e in sorted(es, key=lambda e: e.first)], np.int64)
        for n, es in by_length.items()
    }


def place_column(spark, entries: list[Entry], length: Column, rank: Column) -> Column:
    """A struct (sequence_id, offset). The plan's size depends on the capacity alone; it is broadcast."""
    shared = spark.sparkContext.broadcast(_places(entries))

    def batch(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, r = lengths.to_numpy(), ranks.to_numpy()
        bins, offsets = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for size in np.unique(n):
            mine = np.flatnonzero(n == size)
            rows = shared.value[int(size)]
            first, start, each, offset = rows[np.searchsorted(rows[:, 0], r[mine], side="right") - 1].T
            place = r[mine] - first
            bins[mine] = start + place // each
            offsets[mine] = offset + place % each * size
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    return F.pandas_udf(batch, "sequence_id long, offset long")(length, rank)


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: full ones, the first may be shorter."""
    head = (total - 1) % capacity + 1
    return [(0, head), *((at, capacity) for at in range(head, total, capacity))]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a tokenised text: doc_id, piece, start, length, ids_crc32.

    A NULL or empty text is its end id alone. Repeated rows give repeated pieces.
    """

    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("doc_id"))
    shared = encoder(docs.sparkSession, vocabulary, spaced=True)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = shared.value.encode, np.array([END], "<u4").tobytes()
        for batch in batches:
            owners, made = [], []
            for row, text in enumerate(batch.column(0)):
                ids = encode(text.as_py()) + end
                for i, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    owners.append(row)
                    made.append((i, s, n, crc(ids[4 * s : 4 * (s + n)])))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*made), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if made:
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(owners)), *columns], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(part, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with sequence_id and offset. An empty table gives an empty result.

    A NULL id is an id like any other; other columns are not read.
    """
    cut_up = Staged(pieces(docs, vocabulary, id_col, text_col, capacity), "pieces").frame
    histogram = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}
    entries = plan(histogram, capacity)
    salts = max(64, max(histogram.values(), default=0) // GROUP)
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    # at most capacity x salts rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").count()
    counts = counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(counts, ["length", "salt"])
    place = place_column(docs.sparkSession, entries, F.col("length"), F.col("rank") + F.col("before"))
    return ranked.withColumn("place", place).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"
    )
