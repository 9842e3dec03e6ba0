"""The steps of the score on windows, by native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns
from windowmatch.functions import matrix as M


def with_matrix(filled: DataFrame, cols: SearchColumns) -> DataFrame:
    """Adds the window matrix ``x`` to rows that hold the bars of a window in ``bars``."""
    return filled.withColumn("x", M.as_matrix(F.col("bars"), cols.match)).drop("bars")


def correlation_steps(
    filled: DataFrame,
    pattern: Sequence[Sequence[float]],
    cols: SearchColumns,
    normalize: str = "mean",
    passes: int = 2,
) -> DataFrame:
    """Covariances and correlation with the pattern, for windows as long as the pattern.

    The pattern is a frame of one row, which the plan reads by a scalar subquery: its size does not
    depend on the pattern's.
    """
    width = len(cols.match)
    rows = [([[float(v) for v in row] for row in pattern],)]
    given = filled.sparkSession.createDataFrame(rows, "m array<array<double>>")
    one = given.select(M.centred_distances(F.col("m"), width, normalize, passes, len(pattern)).alias("p"))
    one = one.select(F.struct("p", M.distance_variance(F.col("p")).alias("var")).alias("pattern"))
    same = with_matrix(filled.where(F.size("bars") == len(pattern)), cols)
    centred = same.select(
        *cols.window_key,
        M.centred_distances(F.col("x"), width, normalize, passes, len(pattern)).alias("centred"),
    )
    known = centred.withColumn("pattern", one.scalar())
    covs = known.select(
        *cols.window_key,
        M.distance_covariance(F.col("centred"), F.col("pattern.p")).alias("cov_ab"),
        M.distance_variance(F.col("centred")).alias("cov_aa"),
        F.col("pattern.var").alias("cov_bb"),
    )
    corr = M.distance_correlation(F.col("cov_ab"), F.col("cov_aa"), F.col("cov_bb"))
    return covs.withColumn("similarity", corr).drop("cov_bb")
