import datetime as dt
import random

import fixtures as fx
import pytest

from windowmatch.config import SearchColumns
from windowmatch.functions.times import micros
from windowmatch.operators import range_join
from windowmatch.operators.topk import top_k
from windowmatch.plans.similarity import similarities, similarity, similarity_grouped

COLS = SearchColumns()
WINDOWS = "sid bigint, begintime timestamp_ntz, endtime timestamp_ntz, period int"


@pytest.fixture(scope="module")
def rows():
    return fx.random_bars({1: 400, 2: 60, 3: 25}, seed=5, step=dt.timedelta(hours=7, microseconds=13))


@pytest.fixture(scope="module")
def bars(spark, rows):
    return spark.createDataFrame(rows, fx.BARS).repartition(6)


def random_windows(rows, seed=2):
    """Spans from nothing to everything, a security without bars, and a reversed window."""
    rng = random.Random(seed)
    times = [r[2] for r in rows]
    found = set()
    for _ in range(150):
        sid = rng.choice((1, 1, 1, 2, 3, 77))
        begin = rng.choice(times)
        span = dt.timedelta(seconds=10 ** rng.uniform(0, 7.5))
        found.add((sid, begin, begin + span, 10))
    found.add((1, min(times), max(times), 10))
    found.add((1, times[0], times[0], 10))
    found.add((2, dt.datetime(1950, 1, 1), dt.datetime(2090, 1, 1), 10))
    found.add((2, times[5], times[5] - dt.timedelta(days=3), 10))
    return sorted(found)


@pytest.mark.parametrize("grouped", [False, True])
def test_window_bars_equal_brute_force(spark, bars, rows, grouped):
    wanted = random_windows(rows)
    windows = spark.createDataFrame(wanted, WINDOWS)
    got = sorted(
        range_join.window_bars(bars, windows, COLS, grouped).select(
            "sid", "begintime", "endtime", "datetime", "open"
        ).collect(),
        key=repr,
    )
    want = []
    for sid, begin, end, _ in wanted:
        inside = fx.bars_in(rows, sid, begin, end)
        want += [(sid, begin, end, r[2], r[3]) for r in inside] or [(sid, begin, end, None, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("plan", [similarity, similarity_grouped])
def test_similarity_keeps_every_window(spark, bars, rows, plan):
    wanted = random_windows(rows) + [
        (sid, begin, end, 6) for sid, begin, end in fx.windows_of(rows, 6)
    ]
    wanted.append(wanted[-1])  # a repeated window comes back twice
    pattern = [list(r[3:]) for r in fx.by_sid(rows)[2][:6]]
    got = sorted(plan(bars, spark.createDataFrame(wanted, WINDOWS), pattern, COLS).collect())
    want = []
    for sid, begin, end, _ in wanted:
        x = [list(r[3:]) for r in fx.bars_in(rows, sid, begin, end)]
        want.append((sid, begin, end, fx.correlation(x, pattern) if x else None))
    want.sort(key=lambda r: r[:3])
    assert [tuple(r)[:3] for r in got] == [r[:3] for r in want]
    for row, (*_, score) in zip(got, want):
        assert row["similarity"] == (None if score is None else pytest.approx(score, abs=1e-9))


def test_scores_of_listed_windows_keep_their_order(bars, rows):
    samples = fx.windows_of(rows, 6)[::9]
    random.Random(1).shuffle(samples)
    samples += [(77, fx.day(0), fx.day(1)), samples[0]]
    pattern = [list(r[3:]) for r in fx.by_sid(rows)[3][:6]]
    got = similarities(bars, samples, pattern, COLS)
    want = [
        fx.correlation([list(r[3:]) for r in fx.bars_in(rows, *s)], pattern) if s[0] != 77 else None
        for s in samples
    ]
    assert got == [None if w is None else pytest.approx(w, abs=1e-9) for w in want]


def test_cell_widths_keep_the_join_small():
    day, year = 86_400_000_000, 365 * 86_400_000_000
    cases = {
        "one length": [(10 * day, 1000)],
        "a rare long window": [(10 * day, 1000), (10 * year, 1)],
        "rare short windows": [(1, 5), (10 * day, 1000)],
        "two common lengths": [(day // 24, 500), (year, 500)],
        "one huge window": [(1000 * year, 1)],
        "a huge window among many": [(1000, 10**9), (1000 * year, 1)],
        "every length": [(4**i, 7) for i in range(27)],
    }
    for classes in cases.values():
        total = sum(n for _, n in classes)
        widths = range_join.cell_widths(classes)
        assert widths[-1][0] == classes[-1][0]
        assert list(widths) == sorted(widths)
        for span, n in classes:
            width = next(w for longest, w in widths if span <= longest)
            touched = span // width + 2
            assert touched <= range_join.MAX_CELLS + 2
            assert n * touched <= 4 * total
    for name in ("one length", "a rare long window", "rare short windows", "one huge window"):
        assert len(range_join.cell_widths(cases[name])) == 1
    assert range_join.cell_widths(cases["a rare long window"])[0][1] <= 10 * day
    assert len(range_join.cell_widths(cases["two common lengths"])) == 2


def test_a_long_window_does_not_gather_a_large_security_in_one_cell(spark):
    """A third of the bars is one security, and one window covers all of them."""
    bars = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 1, id % 500 + 2) AS sid",
        "timestamp_ntz'2020-01-01' + make_dt_interval(0, id % 9000) AS datetime",
        "1D AS open", "1D AS high", "1D AS low", "1D AS close",
    )
    short = [(s, fx.day(d), fx.day(d + 1), 1) for s in range(1, 5) for d in range(0, 370, 2)]
    windows = spark.createDataFrame([*short, (1, fx.day(0), fx.day(400), 1)], WINDOWS)
    cells = range_join.measure(windows, COLS)
    right = range_join._bar_cells(bars, COLS, cells)
    assert len(cells.widths) == 1
    assert right.count() == bars.where("sid <= 4 AND datetime <= timestamp_ntz'2021-02-04'").count()
    largest = right.groupBy("sid", "_cell").count().agg({"count": "max"}).first()[0]
    assert largest < 100
    assert range_join._window_cells(windows, COLS, cells).count() < 4 * windows.count()
    found = range_join.matched_bars(bars, windows, COLS)
    whole = found.where("endtime > timestamp_ntz'2021-01-01'")
    assert whole.where("begintime = timestamp_ntz'2020-01-01'").count() == 10_000


def test_no_windows(spark, bars):
    windows = spark.createDataFrame([], WINDOWS)
    assert similarity(bars, windows, [[1.0] * 4] * 3, COLS).count() == 0
    assert range_join.window_bars(bars, windows, COLS).count() == 0


def test_both_plans_find_the_same_once(spark, bars, rows):
    windows = spark.createDataFrame(random_windows(rows), WINDOWS)
    both = [range_join.window_bars(bars, windows, COLS, grouped=g) for g in (True, False)]
    assert sorted(both[0].collect(), key=repr) == sorted(both[1].collect(), key=repr)
    for found in both:  # what is left of the plan reads the staged matches
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "datetime" not in plan.split("LeftAnti")[-1] and "_cell" not in plan


def test_a_window_with_too_many_bars_is_cut_before_the_shuffle(spark, bars, rows):
    windows = spark.createDataFrame(random_windows(rows), WINDOWS)
    found = range_join.window_matrices(bars, windows, COLS, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert all(len(r["bars"]) == 6 for r in found.collect())


def test_two_exchanges_are_interleaved(spark):
    rows = [(1, x, fx.day(i), 1.0 + i, 2.0, 3.0, 4.0) for i in range(3) for x in ("B", "A")]
    windows = spark.createDataFrame([(1, fx.day(0), fx.day(2), 3)], WINDOWS)
    found = range_join.window_matrices(spark.createDataFrame(rows, fx.BARS), windows, COLS, 6)
    assert [b["exchangeCD"] for b in found.first()["bars"]] == ["A", "B"] * 3


def test_other_column_names_and_zoned_time(spark):
    cols = SearchColumns(sid="s", time="t", match=("p",), begin="b", end="e")
    bars = spark.createDataFrame(
        [(1, fx.day(i), float(i * i + 1)) for i in range(20)], "s int, t timestamp, p double"
    )
    windows = spark.createDataFrame(
        [(1, fx.day(i), fx.day(i + 3)) for i in range(17)], "s int, b timestamp, e timestamp"
    )
    pattern = [[float(i * i + 1)] for i in range(4)]
    got = similarity(bars, windows, pattern, cols).orderBy("b").collect()
    assert got[0]["similarity"] == pytest.approx(1.0)
    assert len(got) == 17 and all(r["similarity"] is not None for r in got)


def test_micros_of_both_timestamp_types(spark):
    text = "SELECT timestamp_ntz'1969-12-31 23:59:58.75' AS a, timestamp'1969-12-31 23:59:58.75' AS b"
    frame = spark.sql(text)
    assert frame.select(micros(frame, "a"), micros(frame, "b")).first()[:] == (-1250000, -1250000)


def test_top_k_order(spark):
    rows = [
        (1, fx.day(0), fx.day(1), 0.5),
        (1, fx.day(2), fx.day(3), 0.5),
        (2, fx.day(0), fx.day(1), 0.5),
        (3, fx.day(0), fx.day(1), float("nan")),
        (4, fx.day(0), fx.day(1), None),
        (0, fx.day(0), fx.day(1), 0.9),
        (5, fx.day(0), fx.day(1), 0.1),
    ]
    scored = spark.createDataFrame(
        rows, "sid bigint, begintime timestamp_ntz, endtime timestamp_ntz, similarity double"
    )
    got = [(r["rank"], r["sid"], r["begintime"]) for r in top_k(scored, COLS, k=4).collect()]
    assert got == [(1, 0, fx.day(0)), (2, 2, fx.day(0)), (3, 1, fx.day(2)), (4, 1, fx.day(0))]
