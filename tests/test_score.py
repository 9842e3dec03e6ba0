import random

import fixtures as fx
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns
from windowmatch.functions import kernel
from windowmatch.plans.similarity import score_windows
from windowmatch.plans.steps import correlation_steps

COLS = SearchColumns()
FILLED = (
    "sid bigint, begintime timestamp_ntz, endtime timestamp_ntz, "
    "bars array<struct<datetime:timestamp_ntz,open:double,high:double,low:double,close:double>>"
)


def matrices(count, n, seed=3):
    rng = random.Random(seed)
    return [[[rng.uniform(1, 9) for _ in range(4)] for _ in range(n)] for _ in range(count)]


def filled(spark, xs):
    rows = [
        (i, fx.day(i), fx.day(i + 1), [(fx.day(j), *r) for j, r in enumerate(x)])
        for i, x in enumerate(xs)
    ]
    return spark.createDataFrame(rows, FILLED)


def scores(frame):
    return [r["similarity"] for r in frame.orderBy("sid").collect()]


@pytest.mark.parametrize("normalize", ["mean", "none"])
@pytest.mark.parametrize("passes", [1, 2])
def test_kernel_and_native_steps_equal_the_definition(spark, normalize, passes):
    xs = matrices(40, 7)
    frame = filled(spark, xs)
    want = [fx.correlation(x, xs[0], normalize, passes) for x in xs]
    arrow = scores(score_windows(frame, xs[0], COLS, normalize, passes))
    native = scores(correlation_steps(frame, xs[0], COLS, normalize, passes))
    assert arrow == pytest.approx(want, abs=1e-10)
    assert native == pytest.approx(want, abs=1e-10)


def test_undefined_scores_are_null(spark):
    good = matrices(1, 5)[0]
    constant = [[2.0] * 4] * 5
    zero_mean = [[v, 1.0, 2.0, float(i)] for i, v in enumerate((-2.0, -1.0, 0.0, 1.0, 2.0))]
    missing = [[None, 1.0, 2.0, 3.0], *good[1:]]
    xs = [good, constant, zero_mean, missing, good[:4], [*good, good[0]], []]
    got = scores(score_windows(filled(spark, xs), good, COLS))
    assert got[0] == pytest.approx(1.0)
    assert got[1:] == [None] * 6


def test_score_is_not_evaluated_twice_under_a_filter(spark):
    x = matrices(1, 5)[0]
    scored = score_windows(filled(spark, [x]), x, COLS).where(F.col("similarity") > 0.5)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_bad_options_are_refused(spark):
    bars = F.col("bars")
    for pattern, options in (([[1.0]], {}), ([], {}), ([[1.0] * 4], {"passes": 3})):
        with pytest.raises(ValueError):
            kernel.score(bars, pattern, COLS.match, **options)
    with pytest.raises(ValueError):
        kernel.score(bars, [[1.0] * 4], COLS.match, normalize="z")


cells = st.floats(min_value=0.5, max_value=50, allow_nan=False)
matrix = st.lists(st.lists(cells, min_size=3, max_size=3), min_size=6, max_size=6)


def correlate(x, y, normalize="mean", passes=2):
    centred = kernel.centred_distances(np.array([y]), normalize, passes)[..., 0]
    with np.errstate(all="ignore"):
        return kernel.correlations(np.array([x]), centred, normalize, passes)[0]


@settings(max_examples=60, deadline=None)
@given(matrix, matrix, st.permutations(range(6)), st.floats(min_value=0.1, max_value=20))
def test_properties_of_the_score(x, y, order, factor):
    if min(np.std(x, axis=0).max(), np.std(y, axis=0).max()) < 1e-2:
        return
    score = correlate(x, y)
    assert -1e-9 <= score <= 1 + 1e-9
    assert correlate(x, x) == pytest.approx(1.0)
    assert score == pytest.approx(correlate(y, x), abs=1e-7)
    assert score == pytest.approx(correlate(np.array(x) * factor, y), abs=1e-7)
    moved = correlate([x[i] for i in order], [y[i] for i in order])
    assert score == pytest.approx(moved, abs=1e-7)


def test_long_patterns(spark):
    x = np.array(matrices(3, 100))
    centred, block = kernel._checked(x[0].tolist(), 4, "mean", 2)
    got = kernel._blocks(x, centred, block, "mean", 2).to_pylist()
    for one, score in zip(x.tolist(), got):
        assert score == pytest.approx(fx.correlation(one, x[0].tolist()), abs=1e-9)
    long = matrices(1, 1500)[0]
    centred, block = kernel._checked(long, 4, "mean", 1)
    assert block == 1
    assert kernel._blocks(np.array([long]), centred, block, "mean", 1).to_pylist() == [pytest.approx(1)]


def test_plan_of_the_steps_does_not_grow_with_the_pattern(spark):
    sizes = []
    for n in (4, 40):
        x = matrices(2, n)
        plan = correlation_steps(filled(spark, x), x[0], COLS)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
    assert sizes[1] < 1.2 * sizes[0]
