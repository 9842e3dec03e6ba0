"""Namespaces, keyed tables, bulk loads and the upsert into a table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowmatch.config import SearchColumns
from windowmatch.operators.scan import MONTH, month_of, stored_by_month
from windowmatch.operators.upsert import latest, upsert
from windowmatch.sources.bar_files import BARS_SCHEMA, SEQ, placed
from windowmatch.staging import Scratch, exists

WINDOWS_SCHEMA = T.StructType(
    [
        T.StructField("sid", T.IntegerType()),
        T.StructField("begintime", T.TimestampNTZType()),
        T.StructField("endtime", T.TimestampNTZType()),
        T.StructField("period", T.IntegerType()),
    ]
)

# Column order of an exported bars file that names no columns: key first,
# the rest by name.
BARS_FILE_ORDER = (
    "sid", "datetime", "exchangeCD", "close", "high", "low", "open", "pre_close", "volume",
)

BARS_KEY = ("sid", "datetime", "exchangeCD")


def reset_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Drop a namespace with all its tables, create it again and use it."""
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name}" + (f" LOCATION '{location}'" if location else ""))
    spark.sql(f"USE {name}")


def create_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    partition_by: Sequence[str] = (),
    location: str | None = None,
) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet{parts}{place}")


def create_bars_table(
    spark: SparkSession, table: str, schema: T.StructType = BARS_SCHEMA, location: str | None = None
) -> None:
    """A bars table, split by month so that an upsert rewrites only the months it touches."""
    month = T.StructField(MONTH, T.IntegerType())
    create_table(spark, table, T.StructType([*schema, month]), [MONTH], location)


def bars_folder(spark: SparkSession, path: str) -> str:
    """The name, in this session, of the bars table in a folder; it need not exist before.

    Without a catalog that outlives the session, a folder is what several processes share.
    """
    name = f"bars_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        stored = exists(spark, path)
        create_bars_table(spark, name, location=path)
        if stored:
            spark.catalog.recoverPartitions(name)
    return name


def read_bars(spark: SparkSession, table: str, begin=None, end=None) -> DataFrame:
    """The bars of a table; with a closed time range, only the months it touches are read.

    Filters by ``scan.by_time``, and joins with windows, read only the months of their range anyway.
    """
    bars = spark.table(table)
    if begin is not None:
        bars = bars.where(F.col(MONTH) >= begin.year * 100 + begin.month)
    if end is not None:
        bars = bars.where(F.col(MONTH) <= end.year * 100 + end.month)
    return stored_by_month(bars.drop(MONTH))


def _with_month(bars: DataFrame, cols: SearchColumns) -> DataFrame:
    return bars.withColumn(MONTH, month_of(F.col(cols.time)))


def _clustered(bars: DataFrame, cols: SearchColumns) -> DataFrame:
    """Rows in table order over evenly filled tasks, so files of a month cover few securities."""
    key = (MONTH, *cols.bar_key(bars))
    return bars.repartitionByRange(*key).sortWithinPartitions(*key)


def append_bars(
    spark: SparkSession, table: str, bars: DataFrame, cols: SearchColumns = SearchColumns()
) -> None:
    """Add bars whose keys are not in the table yet."""
    rows = _clustered(_with_month(bars, cols), cols)
    rows.select(*spark.table(table).columns).write.insertInto(table)


def create_windows_table(spark: SparkSession, table: str) -> None:
    create_table(spark, table, WINDOWS_SCHEMA)


def load_delimited(
    spark: SparkSession,
    path: str,
    table: str,
    columns: Sequence[str] | None = None,
    sep: str = ",",
    null_text: str = "",
    quote: str = '"',
) -> None:
    """Append a headerless delimited file to a table.

    ``columns`` gives the order in the file, by default the order of the table. A cell
    that does not fit its column becomes NULL.
    """
    target = spark.table(table)
    order = list(columns or target.columns)
    schema = T.StructType([target.schema[c] for c in order])
    rows = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("nullValue", null_text)
        .option("quote", quote)
        .csv(path)
    )
    rows.select(*target.columns).write.insertInto(table)


def load_data(spark: SparkSession, path: str, table: str) -> None:
    """Load a text file in the Hive default layout: fields split by \\x01, \\N for NULL."""
    load_delimited(spark, path, table, sep="\x01", null_text="\\N", quote="")


def load_bars(
    spark: SparkSession, path: str, table: str, columns: Sequence[str] = BARS_FILE_ORDER
) -> DataFrame:
    """Append an exported, headerless bars file to a bars table; returns the rejected rows.

    A row is rejected if a cell does not fit its column or a part of its key is missing. Of several
    rows of one key the last one is stored.
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = placed(spark.read.schema(text).csv(path))
    kinds = {c: BARS_SCHEMA[c].dataType for c in columns}
    typed = raw.select(
        *(F.col(c).try_cast(kind).alias(c) for c, kind in kinds.items()),
        F.concat_ws(
            "; ",
            *(F.when(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(), c) for c, kind in kinds.items()),
            *(F.when(F.col(c).isNull(), c) for c in BARS_KEY),
        ).alias("problem"),
        F.to_csv(F.struct(*columns)).alias("line"),
        SEQ,
    )
    fine = typed.where("problem = ''").drop("problem", "line")
    append_bars(spark, table, latest(fine, BARS_KEY, SEQ))
    return typed.where("problem <> ''").select("line", "problem")


def upsert_into(
    spark: SparkSession,
    table: str,
    delta: DataFrame,
    cols: SearchColumns = SearchColumns(),
    seq: str | None = None,
) -> None:
    """Write bars into a bars table; a bar with an existing key replaces the stored one.

    Only the months the new bars fall into are read. New keys alone are appended; a month is rewritten
    only if the values of a stored bar change. Appended and rewritten are different months, written one
    after the other: after a failure between them, the same upsert can simply be repeated.
    """
    stored = spark.table(table)
    key = [MONTH, *cols.bar_key(stored)]
    columns = [*key, *(c for c in stored.columns if c not in key)]
    rows = _with_month(delta, cols).select(*columns, *([seq] if seq else []))
    with Scratch() as scratch:
        fresh = scratch.stage(latest(rows, key, seq), "delta")
        months = [r[0] for r in fresh.select(MONTH).distinct().collect()]
        touched = stored.where(F.col(MONTH).isin(months)).select(*columns)
        values = [c for c in columns if c not in key]
        old, new = (F.struct(*(F.col(f"{side}.{c}") for c in values)) for side in ("old", "new"))
        same = [F.col(f"old.{c}") == F.col(f"new.{c}") for c in key]
        pairs = touched.alias("old").join(fresh.alias("new"), same)
        changed = pairs.where(~old.eqNullSafe(new)).select(f"new.{MONTH}").distinct()
        changed_months = [r[0] for r in changed.collect()]
        is_changed = F.col(MONTH).isin(changed_months)
        unknown = fresh.where(~is_changed).join(touched.select(*key), key, "left_anti")
        append_bars(spark, table, unknown, cols)
        if not changed_months:
            return
        merged = upsert(touched.where(is_changed), fresh.where(is_changed), key)
        rewritten = scratch.stage(_clustered(merged, cols), "merged")
        setting = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(setting)
        spark.conf.set(setting, "dynamic")
        try:
            rewritten.select(*stored.columns).write.mode("overwrite").insertInto(table)
        finally:
            spark.conf.set(setting, before)


def replace_windows(
    windows: DataFrame, period: int, cols: SearchColumns = SearchColumns(), prefix: str = "windows"
) -> str:
    """Drop and replace the windows table of ``period`` bars; returns its name."""
    name = f"{prefix}{period}"
    if cols.namespace:
        name = f"{cols.namespace}.{name}"
    spark = windows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    windows.select(*cols.window_key, cols.period).write.format("parquet").saveAsTable(name)
    return name


def windows_from_rows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A windows frame from windows the caller lists: (sid, begintime, endtime, period)."""
    return spark.createDataFrame(list(rows), WINDOWS_SCHEMA)
