"""Windows matched in the tiles of a laid-out table, against brute force."""

import datetime as dt
import random

import fixtures as fx
import numpy as np
import pyarrow as pa
import pytest
from test_range_join import WINDOWS, random_windows

from windowmatch.config import SearchColumns
from windowmatch.operators import range_join, tile_join
from windowmatch.operators.layout import lay_out
from windowmatch.plans.similarity import similarity

COLS = SearchColumns()


@pytest.fixture(scope="module")
def rows():
    return fx.random_bars({1: 400, 2: 60, 3: 25}, seed=5, step=dt.timedelta(hours=7, microseconds=13))


@pytest.fixture(scope="module", params=[1, 40])
def bars(spark, rows, request):
    return lay_out(spark.createDataFrame(rows, fx.BARS), COLS, tiles=request.param)


def odd_windows(rows):
    """Random windows, repeated ones, and keys that are NULL or lie outside of all bars."""
    some = random_windows(rows)
    first, last = min(r[2] for r in rows), max(r[2] for r in rows)
    some += some[:5] + [(None, first, last, 1), (1, None, last, 1), (1, first, None, 1), (-5, first, last, 1)]
    return some + [(3, last, last, 1), (99, last, last, 1), (1, dt.datetime(1900, 1, 1), dt.datetime(1901, 1, 1), 1)]


def inside(rows, sid, begin, end):
    return [] if None in (sid, begin, end) else fx.bars_in(rows, sid, begin, end)


def test_window_bars_equal_brute_force(spark, bars, rows, monkeypatch):
    wanted = odd_windows(rows)
    found = range_join.window_bars(bars, spark.createDataFrame(wanted, WINDOWS), COLS)
    assert found.columns == ["sid", "begintime", "endtime", "period", "datetime", "exchangeCD", *COLS.match]
    want = []
    for window in wanted:
        covered = inside(rows, *window[:3])
        want += [(*window, r[2], r[1], *r[3:]) for r in covered] or [(*window, *(None,) * 6)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_scores_equal_brute_force(spark, bars, rows):
    for n in (1, 6, 40):
        runs = [(*w, n) for w in fx.windows_of(rows, n)]
        wanted = odd_windows(rows) + runs + runs[:7]
        pattern = [list(r[3:]) for r in fx.by_sid(rows)[1][:n]]
        got = similarity(bars, spark.createDataFrame(wanted, WINDOWS), pattern, COLS).collect()
        memo, want = {}, []
        for sid, begin, end, _ in wanted:
            key = (sid, begin, end)
            if key not in memo:
                x = [list(r[3:]) for r in inside(rows, *key)]
                memo[key] = fx.correlation(x, pattern) if len(x) == n else None
            want.append((*key, memo[key]))
        order = lambda r: repr(r[:3])
        for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
            assert a[:3] == b[:3] and a[3] == (None if b[3] is None else pytest.approx(b[3], abs=1e-9))


def test_no_bar_leaves_its_bucket(spark, bars, rows):
    windows = spark.createDataFrame(odd_windows(rows), WINDOWS)
    pattern = [[1.0] * 4, [2.0, 3.0, 1.0, 2.0]]
    for found in (range_join.window_bars(bars, windows, COLS), similarity(bars, windows, pattern, COLS)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        for block in plan.split("Exchange")[1:]:
            assert "FileScan" not in block.split("Scan ExistingRDD")[0].split(":-")[0]
        # the windows are dealt to the buckets of the bars, once
        assert plan.count("REPARTITION_BY_NUM") >= 1 and "ENSURE_REQUIREMENTS" not in plan


def test_derived_frames_take_the_other_plan(spark, bars, rows):
    windows = spark.createDataFrame(random_windows(rows), WINDOWS)
    half = bars.where("datetime < timestamp_ntz'2020-03-01'")
    got = range_join.window_bars(half, windows, COLS).collect()
    want = range_join.window_bars(half.drop("tile"), windows, COLS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_windows_in_many_batches(spark, bars, rows, monkeypatch):
    windows = spark.createDataFrame(odd_windows(rows), WINDOWS)
    want = sorted(map(tuple, range_join.window_bars(bars, windows, COLS).collect()), key=repr)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, 5)
    monkeypatch.setattr(tile_join, "CHUNK", 7)
    try:
        got = range_join.window_bars(bars, windows, COLS).collect()
    finally:
        spark.conf.unset(setting)
    assert sorted(map(tuple, got), key=repr) == want


def test_two_exchanges_are_interleaved(spark):
    rows = [(1, x, fx.day(i), 1.0 + i, 2.0, 3.0, 4.0) for i in range(30) for x in ("B", "A")]
    bars = lay_out(spark.createDataFrame(rows, fx.BARS), COLS, tiles=7)
    windows = spark.createDataFrame([(1, fx.day(i), fx.day(i + 2), 3) for i in range(30)], WINDOWS)
    found = range_join.window_bars(bars, windows, COLS).collect()
    assert len(found) == 28 * 6 + 4 + 2
    pattern = [list(r[3:]) for r in sorted(rows, key=lambda r: (r[2], r[1]))[:6]]
    scores = similarity(bars, windows, pattern, COLS).orderBy("begintime").collect()
    assert scores[0]["similarity"] == pytest.approx(1.0)
    assert [r["similarity"] is None for r in scores] == [False] * 28 + [True] * 2


def test_spans_by_binary_search():
    rng = random.Random(4)
    pairs = sorted((rng.choice([3, 5, 9]), rng.randrange(40)) for _ in range(200))
    index = tile_join.Ranks(pa.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    asked = [(rng.choice([2, 3, 4, 5, 9, 10]), rng.randrange(-2, 42), rng.randrange(-2, 42)) for _ in range(400)]
    first, count = index.spans(pa.array([a[0] for a in asked]), *(np.array([a[i] for a in asked]) for i in (1, 2)))
    for (sid, begin, end), f, c in zip(asked, first, count):
        assert [p for p in pairs if p[0] == sid and begin <= p[1] <= end] == pairs[f : f + c]
    sids, times = (np.array([p[i] for p in pairs]) for i in (0, 1))
    sid, time = (np.array([a[i] for a in asked]) for i in (0, 1))
    before = tile_join._before(sids, times, sid, time, "left")
    upto = tile_join._before(sids, times, sid, time, "right")
    assert before.tolist() == [sum(p < (s, t) for p in pairs) for s, t in zip(sid, time)]
    assert upto.tolist() == [sum(p <= (s, t) for p in pairs) for s, t in zip(sid, time)]


def test_matrices_equal_brute_force(spark, bars, rows):
    wanted = odd_windows(rows) + [(*w, 6) for w in fx.windows_of(rows, 6)]
    found = range_join.window_matrices(bars, spark.createDataFrame(wanted, WINDOWS), COLS, 6)
    assert "_cell" not in found._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r)[:3]: [tuple(b) for b in r["bars"]] for r in found.collect()}
    want = {w[:3]: [(r[2], r[1], *r[3:]) for r in inside(rows, *w[:3])] for w in wanted}
    assert got == {key: covered for key, covered in want.items() if len(covered) == 6}

