"""Places of pattern matches in texts, in code points, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Identifies a row of a table of texts: repeated rows of one id and text are one.
KEY = ["doc_id", "text_key"]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and text of every row; a NULL text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Equality of the row keys of two tables; NULL ids are equal."""
    return left.doc_id.eqNullSafe(right.doc_id) & (left.text_key == right.text_key)


def matches(rows: DataFrame, pattern: str, before: int = 0, after: int = 0) -> DataFrame:
    """Every match of ``pattern``, leftmost and non-overlapping: the key, value, start, end (exclusive).

    With ``before`` and ``after``, also that many characters around it, as ``left`` and ``right``, as
    far as no other match lies between. The texts themselves do not leave their tasks.
    """
    # split() and regexp_extract_all() walk over the same matches; what lies between gives the places
    cut = rows.where(F.col("text").rlike(pattern)).select(
        *KEY, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), F.split("text", pattern, -1).alias("gaps")
    )
    fields = [
        F.transform("gaps", lambda g: F.length(g)).alias("gap"),
        F.col("found").alias("value"),
        F.transform("gaps", lambda g: F.right(g, F.lit(before))).alias("left"),
        F.transform(F.slice("gaps", F.lit(2), F.size("gaps")), lambda g: F.left(g, F.lit(after))).alias("right"),
    ]
    zipped = F.arrays_zip(*(fields if before or after else fields[:2]))
    each = cut.select(*KEY, F.posexplode(zipped).alias("at", "m")).where(F.col("m.value").isNotNull())
    each = each.select(*KEY, "at", "m.*").dropDuplicates([*KEY, "at"])
    until = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(until)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    context = ["left", "right"] if before or after else []
    return placed.select(*KEY, "value", "start", "end", *context)

