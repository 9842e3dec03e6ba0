"""Window statistics as native column expressions.

A matrix column is ``array<array<double>>``: one inner array per bar, bars in time
order. All functions map columns to columns and add no shuffle. They make each step
of the score available by itself; scoring many windows uses the Arrow kernel in
``kernel.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _mean(values: Column) -> Column:
    return F.try_divide(_sum(values), F.size(values))


def as_matrix(bars: Column, match: Sequence[str]) -> Column:
    """Rows are bars, columns are the match columns in the configured order."""
    return F.transform(bars, lambda b: F.array(*(b[c].cast("double") for c in match)))


def column_means(x: Column, width: int) -> Column:
    return _let(
        x, lambda m: F.array(*(_mean(F.transform(m, lambda r: r[c])) for c in range(width)))
    )


def column_stddevs(x: Column, width: int) -> Column:
    """Sample standard deviation of every column."""

    def spread(m: Column, mean: Column, c: int) -> Column:
        squares = F.transform(m, lambda r: (r[c] - mean) * (r[c] - mean))
        return F.sqrt(F.try_divide(_sum(squares), F.size(m) - 1))

    return _let(
        x,
        lambda m: _let(
            column_means(m, width),
            lambda means: F.array(*(spread(m, means[c], c) for c in range(width))),
        ),
    )


def scale_by_mean(x: Column, width: int) -> Column:
    """Divide every column by its mean; a zero mean gives NULL cells."""
    return _let(
        x,
        lambda m: _let(
            column_means(m, width),
            lambda means: F.transform(m, lambda r: F.zip_with(r, means, F.try_divide)),
        ),
    )


# Differences of rows up to this wide are written out, cell by cell.
WRITTEN_OUT = 16


def pair_distance(x: Column, width: int | None = None) -> Column:
    """Euclidean distance between all rows of ``x``, from the differences themselves.

    Every pair is measured once: a packed triangle holds the distances of each row to itself and to
    those below it, and the matrix is read off that. ``width``: the number of columns, if it is known.
    """

    def distance(r: Column, s: Column) -> Column:
        if width and width <= WRITTEN_OUT:
            return F.sqrt(reduce(add, ((r[c] - s[c]) * (r[c] - s[c]) for c in range(width))))
        return F.sqrt(_sum(F.zip_with(r, s, lambda u, v: (u - v) * (u - v))))

    def triangle(m: Column) -> Column:
        below = lambda r, i: F.transform(F.slice(m, i + 1, F.size(m)), lambda s: distance(r, s))
        return F.flatten(F.transform(m, below))

    def cell(packed: Column, i: Column, j: Column, n: Column) -> Column:
        upper, lower = F.least(i, j), F.greatest(i, j)
        return F.get(packed, upper * n - F.shiftright(upper * (upper - 1), 1) + lower - upper)

    def whole(m: Column, packed: Column) -> Column:
        n = F.size(m)
        return F.transform(m, lambda _r, i: F.transform(m, lambda _s, j: cell(packed, i, j, n)))

    return _let(x, lambda m: _let(triangle(m), lambda packed: whole(m, packed)))


def center(d: Column) -> Column:
    """Double centring of a distance matrix, whose column means are its row means."""

    def centred(m: Column, means: Column, grand: Column) -> Column:
        return F.transform(
            m, lambda r, i: F.transform(r, lambda v, j: v - means[i] - means[j] + grand)
        )

    return _let(
        d,
        lambda m: _let(
            F.transform(m, _mean),
            lambda means: _let(_mean(means), lambda grand: centred(m, means, grand)),
        ),
    )


def centred_distances(
    x: Column, width: int, normalize: str = "mean", passes: int = 2, n: int | None = None
) -> Column:
    """All steps from the window matrix to its centred distance matrix; ``n``: the number of bars, if known."""
    d = scale_by_mean(x, width) if normalize == "mean" else x
    for columns in (width, n)[:passes]:
        d = pair_distance(d, columns)
    return center(d)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(
        F.zip_with(a, b, lambda r, s: _sum(F.zip_with(r, s, lambda u, v: u * v)))
    )


def distance_covariance(a: Column, b: Column) -> Column:
    """Covariance of two centred distance matrices of the same size."""
    return _let(
        a, lambda m: F.try_divide(F.sqrt(F.greatest(inner_product(m, b), F.lit(0.0))), F.size(m))
    )


def distance_variance(a: Column) -> Column:
    return _let(a, lambda m: distance_covariance(m, m))


def distance_correlation(cov_ab: Column, cov_aa: Column, cov_bb: Column) -> Column:
    return F.try_divide(cov_ab, F.sqrt(cov_aa * cov_bb))
