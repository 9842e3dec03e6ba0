"""SimHash near-duplicates by one-wildcard variants of half fingerprints.

A fingerprint has 64 bits; two link if they differ in at most two. Cut into two segments of 32
bits, the differing bits lie in one segment, or one in each: then the first segment differs in
exactly one bit, and the variant of both with that bit masked out is the same. So a fingerprint is
indexed under

* each whole segment, for pairs that differ in the other segment only, and
* each of the 32 one-wildcard variants of the first segment, for pairs with one bit in each.

Every key also holds a part of the other segment that must be equal in such a pair (one of three
parts if two bits may differ there, one of two if one bit differs). This makes 3 + 3 + 64 keys of 42
to 47 bits a fingerprint, and leaves at most 2**22 fingerprints to a key whatever the data are.
Equality-joined candidates are verified by the bits in which they differ. Equal fingerprints are
one row before the index is built: copies never meet in a join.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from windowmatch.llm.components import components
from windowmatch.llm.shared import Staged, free_name

SHINGLE = 3
MAX_BITS = 2
SEED = 42
STEP = 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        total = 1
    else:
        total = len(words) - shingle + 1
    counts = np.zeros((8, 8), np.int64)
    width = shingle if len(words) >= shingle else 1
    for at in range(0, total, STEP):
        n = min(STEP, total - at)
        if width == 1:
            shingles = words[at : at + n]
        else:
            shingles = map(b" ".join, zip(*(words[at + k : at + k + n] for k in range(width))))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
        places = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            counts[byte] += np.bincount(places[:, byte], minlength=256) @ _BITS
    bits = (2 * counts > total).reshape(-1)
    value = int(np.packbits(bits, bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column, whole texts, in Arrow batches."""

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return F.pandas_udf(batch, "long")(text.cast("binary"))


def _keys() -> Column:
    """The 70 index keys of a fingerprint ``fp``."""
    ones = 0xFFFFFFFF
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(ones))
    parts = ((0, 11), (11, 11), (22, 10))
    halves = ((0, 16), (16, 16))

    def part(segment: Column, at: int, width: int) -> Column:
        return F.shiftright(segment, at).bitwiseAND(F.lit((1 << width) - 1))

    keys = [
        F.xxhash64(F.lit(1000 * s + i), whole, part(other, *p))
        for s, (whole, other) in enumerate(((high, low), (low, high)))
        for i, p in enumerate(parts)
    ]
    keys += [
        F.xxhash64(F.lit(2000 + 2 * bit + i), high.bitwiseAND(F.lit(ones ^ (1 << bit))), part(low, *p))
        for bit in range(32)
        for i, p in enumerate(halves)
    ]
    return F.array(*keys)


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints ``fp`` that differ in at most two bits, each once."""
    indexed = fingerprints.select("fp", F.explode(_keys()).alias("key"))
    # Spark takes the index for as small as the fingerprints, so it must not choose to broadcast it
    left, right = indexed.toDF("a", "key"), indexed.toDF("b", "key").hint("merge")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return left.join(right, (left.key == right.key) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (XXH64 of the text), fp, root (names the class), component_id."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), fingerprint_column(text).alias("fp"))
    fps = Staged(rows, "fingerprints").frame
    # one row per fingerprint from here on
    distinct = Staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct").frame
    roots = components(fingerprint_links(distinct.select("fp"))).frame
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = placed.join(least, "root").select("fp", "root", "component_id")
    copies = distinct.where("n > 1").join(roots, F.col("node") == F.col("fp"), "left_anti")
    classes = linked.union(copies.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id")))
    return fps.join(classes, "fp", "left").select(
        "doc_id", "key", "fp", F.coalesce("root", "fp").alias("root"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint ``fp`` (long) and the smallest id of its class.

    Defined cases: a NULL or empty text has fingerprint 0 and links with others of that kind; a NULL
    id never names a class (a class without any other id has class id NULL); repeated rows stay; an
    empty table gives an empty result; other columns are not read.
    """
    return _classes(docs, id_col, text_col).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates: of each class one row stays, that with the smallest id, and of
    several texts under that id the one with the smallest XXH64.

    A row is known by its id and its text, so a text stays although another one under its id goes. Rows
    without an id stay.
    """
    found = Staged(_classes(docs, id_col, text_col).where("doc_id IS NOT NULL"), "classes").frame
    keepers = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("kept"))
    rows = found.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    told = Staged(rows.join(keepers, "root").withColumn("stays", F.struct("doc_id", "key") == F.col("kept")), "told").frame
    row_id, row_key = free_name(docs, "gone_id"), free_name(docs, "gone_key")
    gone = told.where("NOT stays").select(F.col("doc_id").alias(row_id), F.col("key").alias(row_key)).distinct()
    same = (F.col(id_col) == F.col(row_id)) & (F.xxhash64(F.col(text_col)) == F.col(row_key))
    kept = docs.join(gone, same, "left_anti")
    if told.where("stays AND n > 1").limit(1).count():
        named = kept.where(F.col(id_col).isNotNull()).withColumn(row_key, F.xxhash64(F.col(text_col)))
        kept = named.dropDuplicates([id_col, row_key]).drop(row_key).union(kept.where(F.col(id_col).isNull()))
    return kept
