"""Bars from a directory of delimited files, one security per file.

The file name ``<sid>.<exchangeCD>.….csv`` names the security; every file starts
with a header.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import or_

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowmatch.functions.times import parse_time
from windowmatch.staging import qualified, stage

# Executors get these functions with the task and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the format of the vendor files.
DEFAULT_TIME_FORMAT = "%Y-%m-%d %H:%M:%S"

# Header names of the vendor files -> column names of the bars table.
VENDOR_NAMES = {
    "PRE_CLOSE": "pre_close",
    "OPEN": "open",
    "HIGH": "high",
    "LOW": "low",
    "CLOSE": "close",
    "VOLUME": "volume",
}

# Cell texts that mean "no value".
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Order of the rows of a read: by file, then by place in the file.
SEQ = "_seq"
PLACE = ("_block", "_line")

NUMBERS = ("open", "high", "low", "close", "pre_close", "volume")

BARS_SCHEMA = T.StructType(
    [
        T.StructField("sid", T.IntegerType()),
        T.StructField("exchangeCD", T.StringType()),
        T.StructField("datetime", T.TimestampNTZType()),
        *(T.StructField(name, T.DoubleType()) for name in NUMBERS),
    ]
)


def _place() -> list[Column]:
    """Columns ``PLACE`` of a read: the split of the file, and a number that rises within it."""
    return [F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]


def placed(raw: DataFrame) -> DataFrame:
    """Rows of a file source with their order in column ``SEQ``."""
    rows = raw.select("*", "_metadata.file_path", *_place())
    return rows.withColumn(SEQ, F.struct("file_path", *PLACE)).drop("file_path", *PLACE)


def read_bar_files(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    header: list[str] | None = None,
    name_column: str | None = None,
) -> DataFrame:
    """All ``*.csv`` files of a directory as text columns plus ``file_name``.

    ``header`` lists the header names; by default the first file gives them. Every
    file is checked against it, and a file with other columns or another order
    fails the read instead of shifting values. Files Spark wrote under
    ``<name_column>=<name>/`` take their name from that folder.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.option("pathGlobFilter", "*.csv")
    if header is None:
        header = [c for c in reader.csv(path).columns if c != name_column]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    if name_column:
        schema = schema.add(name_column, T.StringType())
    raw = reader.option("enforceSchema", False).schema(schema).csv(path)
    if name_column:
        return placed(raw).withColumnRenamed(name_column, "file_name")
    return placed(raw.withColumn("file_name", F.col("_metadata.file_name")))


def read_mixed_bar_files(
    spark: SparkSession,
    path: str | list[str],
    time_column: str = "datetime",
    sep: str = ",",
    nested: bool = False,
) -> DataFrame:
    """Like ``read_bar_files`` for files whose headers differ: each file follows its own.

    ``nested`` reads the files of all folders below ``path`` too.

    The first line of a file that is not blank is its header, and files are told apart by their whole
    path. The headers are found in one pass and staged; in a second one every line is cut into as many cells
    as the widest header has, and the cells are looked up by the header of their own file. A name that a header
    lacks is NULL, so the rows of a file without ``time_column`` are rejected when they are parsed.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", nested)
        .text(path)
        .select("value", "_metadata.file_path", "_metadata.file_name", *_place())
        .where(F.trim("value") != "")
    )
    first = stage(lines.groupBy("file_path").agg(F.min_by("value", F.struct(*PLACE)).alias("header")), "headers")
    width = first.agg(F.max(F.size(F.split("header", f"\\Q{sep}\\E")))).first()[0]
    schema = ", ".join(f"_{i} STRING" for i in range(max(width or 1, 1)))

    def cells(line: str) -> Column:
        # inside a function of an array a line is cut once, not once a cell
        cut = F.array(F.from_csv(line, schema, {"sep": sep}))
        return F.transform(cut, lambda c: F.array(*(c[f"_{i}"] for i in range(max(width or 1, 1)))))[0]

    names = F.filter(cells("header"), lambda name: name.isNotNull())
    headers = first.select("file_path", "header", F.array_distinct(names).alias("names"))
    named = F.map_from_arrays("names", F.slice(cells("value"), F.lit(1), F.size("names")))
    rows = lines.join(headers, "file_path").where("value <> header")
    wanted = [time_column, *VENDOR_NAMES]
    return rows.withColumn("cells", named).select(
        *(F.element_at("cells", name).alias(name) for name in wanted),
        "file_name",
        F.struct("file_path", *PLACE).alias(SEQ),
    )


def _number(text: Column) -> Column:
    return F.when(~F.trim(text).isin(*MISSING_TEXTS), F.trim(text)).try_cast("double")


def _bad_number(text: Column) -> Column:
    return text.isNotNull() & ~F.trim(text).isin(*MISSING_TEXTS) & _number(text).isNull()


def parse_bars(
    raw: DataFrame,
    time_column: str = "datetime",
    time_format: str = DEFAULT_TIME_FORMAT,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Typed bars and the rejected rows of ``raw``.

    Rejected are rows whose file name does not start with a whole number, whose time
    fits no known format, or whose numbers are not numbers. ``strict`` fails the job
    on the first such row instead. The order of the rows stays in column ``SEQ``, if ``raw`` has it.
    """
    named = raw.withColumnsRenamed({**VENDOR_NAMES, time_column: "datetime"})
    name, order = F.col("file_name"), [c for c in (SEQ,) if c in raw.columns]
    typed = named.select(
        F.split_part(name, F.lit("."), F.lit(1)).try_cast("int").alias("sid"),
        F.split_part(name, F.lit("."), F.lit(2)).alias("exchangeCD"),
        parse_time(F.col("datetime"), time_format).alias("datetime"),
        *(_number(F.col(c)).alias(c) for c in NUMBERS),
        reduce(or_, (_bad_number(F.col(c)) for c in NUMBERS)).alias("bad_number"),
        "file_name",
        F.col("datetime").alias("time_text"),
        *order,
    )
    problem = F.concat_ws(
        "; ",
        F.when(F.col("sid").isNull(), "file name"),
        F.when(F.col("datetime").isNull(), "time"),
        F.when(F.col("bad_number"), "number"),
    )
    parsed = typed.withColumn("problem", problem)
    fine = F.col("problem") == ""
    if strict:
        report = F.concat_ws(": ", "file_name", "problem", "time_text")
        fine = F.when(fine, True).otherwise(F.raise_error(report).cast("boolean"))
    return (
        parsed.where(fine).select(*BARS_SCHEMA.fieldNames(), *order),
        parsed.where("problem <> ''").select("file_name", "time_text", "problem"),
    )


def ingest(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    time_column: str = "datetime",
    time_format: str = DEFAULT_TIME_FORMAT,
    strict: bool = False,
    header: list[str] | None = None,
    mixed: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Bars and rejected rows of a directory of bar files; ``mixed`` if their headers differ.

    The bars carry their order in column ``SEQ``: a later row of one key replaces an earlier one.
    """
    if mixed:
        raw = read_mixed_bar_files(spark, path, time_column, sep)
    else:
        raw = read_bar_files(spark, path, sep=sep, header=header)
    return parse_bars(raw, time_column, time_format, strict)


# Characters that Spark writes as %XX in the name of a folder.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _folder(name_column: str, name: str | None) -> str:
    """The folder of one name as ``partitionBy`` has it."""

    def escaped(text: str) -> str:
        return _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", text)

    return f"{escaped(name_column)}={escaped(name) if name else '__HIVE_DEFAULT_PARTITION__'}"


def write_named_files(rows: DataFrame, path: str, name_column: str, sep: str = ",") -> None:
    """``rows`` as delimited files with a header, one folder ``<name_column>=<name>`` per name.

    The rows are spread by name and the first of the other columns, so a name with very many rows becomes
    several files of its folder. On a file system of the machine Spark's writer starts a process for each right
    it sets, four a file; there the tasks write the files themselves. A file appears whole under the number of
    its task, so a task that runs again replaces its own files. ``path`` must be new.
    """
    columns = [c for c in rows.columns if c != name_column]
    spread = rows.repartitionByRange(name_column, columns[0])
    url = qualified(rows.sparkSession, path)
    if url.getScheme() != "file":
        spread.write.partitionBy(name_column).option("header", True).option("sep", sep).csv(path)
        return
    top = url.getPath()
    os.makedirs(top)
    head = F.to_csv(F.struct(*(F.lit(c).alias(c) for c in columns)), {"sep": sep})
    header = rows.sparkSession.range(1).select(head).first()[0]
    line = F.to_csv(F.struct(*columns), {"sep": sep})
    sorted_rows = spread.sortWithinPartitions(name_column, columns[0])
    lines = sorted_rows.select(F.col(name_column).cast("string").alias("name"), line.alias("line"))

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        final = f"part-{TaskContext.get().partitionId():05d}.csv"
        pairs = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        files = 0
        for name, some in groupby(pairs, lambda pair: pair[0] or None):
            folder = f"{top}/{_folder(name_column, name)}"
            os.makedirs(folder, exist_ok=True)
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with open(hidden, "w", encoding="utf-8", newline="") as out:
                out.write(f"{header}\n")
                out.writelines(f"{text}\n" for _, text in some)
            os.replace(hidden, f"{folder}/{final}")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    lines.mapInArrow(write_part, "files long").agg(F.sum("files")).collect()


def write_bar_files(
    bars: DataFrame, path: str, sep: str = ",", name_column: str = "file"
) -> None:
    """The inverse of the ingest: vendor header, one folder ``<sid>.<exchangeCD>.csv`` per security.

    A security with very many bars becomes several files of its folder, split by time.
    """
    named = bars.select(
        F.concat(F.col("sid"), F.lit("."), F.col("exchangeCD"), F.lit(".csv")).alias(name_column),
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").alias("datetime"),
        *(F.col(column).alias(vendor) for vendor, column in VENDOR_NAMES.items()),
    )
    write_named_files(named, path, name_column, sep)
