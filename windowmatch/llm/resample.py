"""Importance resampling towards a target distribution of hashed word features.

Texts are bags of runs of consecutive words. A feature's bucket is the CRC-32 of its bytes modulo the
number of buckets. The corpus and the target each give a distribution over buckets; a document's weight
is the mean log ratio of both over its features, and adding Gumbel noise to the weights and taking the
largest sums draws without replacement in proportion to their exponentials.

The checksums of a batch of texts are computed together: its distinct features are grouped by length in
bytes, each group is a two-dimensional ``uint8`` array with one feature a row, and the checksums of all
rows are updated column by column, by one table lookup a column. The buckets are then scattered back to
the occurrences. A feature's bytes are looked at once per batch, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmatch.llm.shared import Staged

BUCKETS = 10_000
RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bytes of text whose features are hashed together.
CHUNK = 1 << 22

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    """The checksum of every byte, by its rule."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(POLYNOMIAL) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_TABLE = _crc_table()

# Bytes outside words become blanks, A-Z become a-z; bytes from 0x80 on belong to words.
_WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.translate(_WORD_BYTES).split() if text else []


def features(found: list[bytes], run: int = RUN) -> list[bytes]:
    """All runs of 1 to ``run`` consecutive words, joined by one space."""
    out = list(found)
    for n in range(2, run + 1):
        out += map(b" ".join, zip(*(found[i:] for i in range(n))))
    return out


def checksums(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes, one column after the other."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crc32_of(distinct: list[bytes]) -> np.ndarray:
    """CRC-32 of each value, values of equal length together."""
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    joined = np.frombuffer(b"".join(distinct), np.uint8)
    ends = np.cumsum(lengths)
    out = np.empty(len(distinct), np.uint32)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        # one row of bytes for each value of this length; very long ones go in slices of rows
        step = max(1, CHUNK // max(int(length), 1))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            out[some] = checksums(joined[(ends[some] - length)[:, None] + np.arange(length)])
    return out


def _hashed(texts: list[bytes | None], run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: the buckets of all features in order, and for each text its features and words."""
    index: dict[bytes, int] = {}
    places, n_features, n_words = [], [], []
    for text in texts:
        found = words(text)
        every = features(found, run) if run > 1 else found
        places.extend([index.setdefault(f, len(index)) for f in every])
        n_features.append(len(every))
        n_words.append(len(found))
    bucket_of = (crc32_of(list(index)) % np.uint32(buckets)).astype(np.int64)
    return bucket_of[np.array(places, np.int64)], np.array(n_features, np.int64), np.array(n_words, np.int64)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes | None]]]:
    """Consecutive texts of about ``CHUNK`` bytes together, with the row of the first one."""
    start, size, some = 0, 0, []
    for row, text in enumerate(batch.column(column)):
        value = text.as_py()
        some.append(value)
        size += len(value or b"")
        if size >= CHUNK:
            yield start, some
            start, size, some = row + 1, 0, []
    if some:
        yield start, some


def bucket_counts(texts: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> dict[int, int]:
    """How many features of all texts are in each bucket. A task gives one row per bucket at most."""
    rows = texts.select(F.col(f"`{text_col}`").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in _chunks(batch, 0):
                total += np.bincount(_hashed(some, run, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in found.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """A thousand times the log ratio of the smoothed distributions, per bucket, rounded down."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[list(corpus)], t[list(target)] = list(corpus.values()), list(target.values())
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(
    docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", run: int = RUN
) -> DataFrame:
    """One row per document: doc_id, n_features, n_words, weight (the mean gain, rounded down; 0 without features)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for start, some in _chunks(batch, 1):
                buckets, n, n_words = _hashed(some, run, len(gain))
                sums = np.diff(np.concatenate([[0], np.cumsum(gain[buckets])])[np.concatenate([[0], np.cumsum(n)])])
                columns = [batch.column(0).slice(start, len(some)), *map(pa.array, (n, n_words, sums // np.maximum(n, 1)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "n_words", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc_id {kind}, n_features long, n_words long, weight long")


def gumbel(key: Column, seed: str = SEED) -> Column:
    """A thousand times a Gumbel draw that depends on key and seed, rounded down; NULL counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    run: int = RUN,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, and ``rank`` of the documents drawn.

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred are drawn (rounded down),
    those with the largest scores, of equal ones those with smaller ids. ``target`` holds the texts to come
    near to in its column ``text_col``.

    No sort of all documents: scores are whole numbers, so a count per score shows which scores are drawn
    and where the ranks of each begin. Copies (equal id, features, weight) are one row while they are ranked.

    Defined cases: a NULL or empty text has no features and weight 0; a NULL id counts as the empty text in
    the draw and as the smallest id; repeated rows are drawn one by one; an empty target gives
    gains from the corpus alone; an empty table gives an empty result; other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, run, buckets), bucket_counts(target, text_col, run, buckets), buckets)
    found = weighted(docs, gain, id_col, text_col, run)
    columns = ["doc_id", "n_features", "weight", "score"]
    fit = (F.col("n_words") >= least_words).alias("fit")
    scored = Staged(found.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).select(*columns, fit), "scores").frame
    # one row per score: the range of a score is that of logarithms of counts and of a 32-bit draw
    counts = scored.where("fit").groupBy("score").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    drawn = percent * total // 100
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("start")).where(F.col("start") < drawn)
    starts = Staged(starts, "ranks").frame
    last = starts.agg(F.min("score")).first()[0]
    candidates = F.col("fit") & (F.col("score") >= F.lit(last).cast("long"))
    candidates = F.coalesce(candidates, F.lit(False))
    copies = scored.where(candidates).groupBy(*columns).agg(F.count("*").alias("copies"))
    before = Window.partitionBy("score").orderBy("doc_id", "n_features").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(F.broadcast(starts), "score")
    first = F.col("start") + F.col("before")
    ranked = placed.select(*columns, F.explode(F.sequence(first + 1, first + F.col("copies"))).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~candidates).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)
