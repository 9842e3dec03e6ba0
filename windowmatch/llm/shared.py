"""Helpers of the operators in this subpackage: staged tables and read access to the inputs."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windowmatch.staging import fresh_table


class Staged:
    """A table written to the shared folder once, which can be dropped before the application ends."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.name = fresh_table(self.spark, label)
        df.write.format("parquet").saveAsTable(self.name)

    @property
    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name near ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; an id that is NULL counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def by_hash(key: Column, share: float | Column) -> Column:
    """Whether a row belongs to a fixed pseudo-random share of all rows."""
    place = F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1_000_000_000))
    return place < F.lit(share) * 1_000_000_000


class Memo(dict):
    """A bounded cache that fills itself: two generations, the older one is dropped when the newer is full."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def crc(data: bytes) -> int:
    return zlib.crc32(data)
