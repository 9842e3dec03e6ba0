"""Scoring of windows against one pattern on Arrow batches.

A batch is cut into blocks of numpy arrays with the windows on the last axis: the Python work per
block is a vector operation for every bar of a window, whatever the number of windows in it. Blocks
are cut by the bytes of their arrays; a window too long for that is a block of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowmatch.config import SearchColumns

# Executors get these functions with the task and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NORMALIZATIONS = ("mean", "none")

# Bytes of the distance matrices of a block, which keep the working arrays in the processor cache.
BLOCK_BYTES = 800_000


def _distances(a: np.ndarray) -> np.ndarray:
    """(bars, columns, windows) -> (bars, bars, windows)."""
    n, _, windows = a.shape
    out = np.zeros((n, n, windows))
    for i in range(n - 1):
        gaps = a[i + 1 :] - a[i]
        far = np.sqrt(np.einsum("jcw,jcw->jw", gaps, gaps))
        out[i, i + 1 :] = far
        out[i + 1 :, i] = far
    return out


def centred_distances(x: np.ndarray, normalize: str = "mean", passes: int = 2) -> np.ndarray:
    """(windows, bars, columns) -> centred distance matrices (bars, bars, windows)."""
    a = x / x.mean(axis=1, keepdims=True) if normalize == "mean" else x
    d = np.ascontiguousarray(np.moveaxis(a, 0, -1))
    for _ in range(passes):
        d = _distances(d)
    means = d.mean(axis=1)
    return d - means[:, None] - means[None, :] + means.mean(axis=0)


def correlations(x: np.ndarray, pattern: np.ndarray, normalize: str, passes: int) -> np.ndarray:
    """Distance correlation of every window in ``x`` with the centred ``pattern``."""
    c = centred_distances(x, normalize, passes)
    n = c.shape[0]
    cov = np.sqrt(np.maximum(np.einsum("ijw,ij->w", c, pattern), 0.0)) / n
    var = np.sqrt(np.einsum("ijw,ijw->w", c, c)) / n
    pattern_var = np.sqrt(np.sum(pattern * pattern)) / n
    return cov / np.sqrt(var * pattern_var)


def _checked(pattern: Sequence[Sequence[float]], width: int, normalize: str, passes: int):
    """The pattern's centred distances, and how many windows to score at a time."""
    if normalize not in NORMALIZATIONS:
        raise ValueError(f"normalize must be one of {NORMALIZATIONS}")
    if passes not in (1, 2):
        raise ValueError("passes must be 1 or 2")
    matrix = np.asarray(pattern, dtype=float)
    if matrix.ndim != 2 or matrix.shape[1] != width or not len(matrix):
        raise ValueError("the pattern needs one row per bar and one value per match column")
    with np.errstate(all="ignore"):
        centred = centred_distances(matrix[None], normalize, passes)[..., 0]
    return centred, max(1, BLOCK_BYTES // (8 * len(matrix) ** 2))


def _columns(cells: dict[str, pa.Array], names: Sequence[str]) -> np.ndarray:
    arrays = (pc.cast(cells[c], pa.float64()).to_numpy(zero_copy_only=False) for c in names)
    return np.stack(list(arrays), axis=-1)


def _blocks(
    x: np.ndarray, centred: np.ndarray, block: int, normalize: str, passes: int
) -> pa.Array:
    """Scores of all windows in ``x``; NULL where undefined."""
    out = np.empty(len(x))
    with np.errstate(all="ignore"):
        for start in range(0, len(x), block):
            part = slice(start, start + block)
            out[part] = correlations(x[part], centred, normalize, passes)
    return pa.array(out, mask=~np.isfinite(out))


def scorer(
    pattern: Sequence[Sequence[float]], match: Sequence[str], normalize: str = "mean", passes: int = 2
) -> Callable[[np.ndarray], pa.Array]:
    """Similarities of (windows, bars, columns) to ``pattern``; NULL where undefined."""
    centred, block = _checked(pattern, len(match), normalize, passes)
    return lambda x: _blocks(x, centred, block, normalize, passes)


def score(
    bars: Column,
    pattern: Sequence[Sequence[float]],
    match: Sequence[str],
    normalize: str = "mean",
    passes: int = 2,
) -> Column:
    """Similarity of the bars of each window (``array<struct>``, in time order) to ``pattern``.

    NULL where it is undefined: another number of bars than the pattern, a missing
    price, a zero mean, or no variation.
    """
    centred, block = _checked(pattern, len(match), normalize, passes)
    n, names = len(pattern), list(match)

    @F.arrow_udf("double")
    def correlate(lists: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(lists), n), False)
        cells = lists.filter(fits).flatten()
        x = _columns({c: pc.struct_field(cells, c) for c in names}, names)
        found = _blocks(x.reshape(-1, n, len(names)), centred, block, normalize, passes)
        return pc.replace_with_mask(pa.nulls(len(lists), pa.float64()), fits, found)

    # Declared non-deterministic so that a filter on the score does not score twice.
    return correlate.asNondeterministic()(bars)


def score_runs(
    placed: DataFrame,
    place: str,
    first: str,
    last: str,
    pattern: Sequence[Sequence[float]],
    cols: SearchColumns,
    normalize: str = "mean",
    passes: int = 2,
) -> DataFrame:
    """Score every run of bars as long as ``pattern`` in partitions of ordered bars.

    ``placed`` numbers the bars of each series from 1 on in ``place``, in the order of
    the rows; a run starts at a bar flagged ``first``, and has a score if it ends at one
    flagged ``last``. Every bar is sent to Python once and batches are taken one by one, with
    the last bars of a batch kept for the next.
    """
    centred, block = _checked(pattern, len(cols.match), normalize, passes)
    n, names = len(pattern), list(cols.match)
    sid, time, begin, end = cols.sid, cols.time, cols.begin, cols.end

    def scored(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*kept, batch]).combine_chunks()
            starts = max(rows.num_rows - n + 1, 0)
            kept = rows.slice(starts).to_batches()
            if not starts:
                continue
            number = rows[place].to_numpy()
            is_run = number[n - 1 :] - number[:starts] == n - 1
            is_run &= rows[first].to_numpy()[:starts]
            whole = pa.array(rows[last].to_numpy()[n - 1 :][is_run])
            x = _columns({c: rows[c].combine_chunks() for c in names}, names)
            runs = np.lib.stride_tricks.sliding_window_view(x, n, axis=0)[is_run]
            scores = _blocks(np.swapaxes(runs, 1, 2), centred, block, normalize, passes)
            mask = pa.array(is_run)
            found = {
                sid: rows[sid].slice(0, starts).filter(mask),
                begin: rows[time].slice(0, starts).filter(mask),
                end: rows[time].slice(n - 1).filter(mask),
                "similarity": pc.if_else(whole, scores, pa.scalar(None, pa.float64())),
            }
            yield from pa.table(found).to_batches()

    schema = T.StructType(
        [
            T.StructField(sid, placed.schema[sid].dataType),
            T.StructField(begin, placed.schema[time].dataType),
            T.StructField(end, placed.schema[time].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    return placed.select(sid, time, place, first, last, *names).mapInArrow(scored, schema)
