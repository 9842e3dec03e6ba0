import datetime as dt
import hashlib
import math
from collections import Counter

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns
from windowmatch.operators import series, windows
from windowmatch.operators.layout import REACH, TILE, borders, lay_out, open_layout, split_sids, tile_count
from windowmatch.plans.search import pattern_search
from windowmatch.plans.similarity import similarity, similarity_of_all
from windowmatch.staging import fresh_table

COLS = SearchColumns()
# Security 1 has more than half of all bars and spans many tiles; 9 is shorter than a window.
COUNTS = {1: 260, 2: 40, 3: 41, 4: 11, 5: 10, 9: 3}


@pytest.fixture(scope="module")
def rows():
    return fx.random_bars(COUNTS)


@pytest.fixture(scope="module", params=["borders", "short borders", "no borders"])
def bars(spark, rows, request):
    """Tiles with a border table, with one that long windows reach beyond, and a frame derived from one."""
    reach = 7 if request.param == "short borders" else REACH
    tiled = lay_out(spark.createDataFrame(rows, fx.BARS), COLS, tiles=16, reach=reach)
    return tiled.select("*").cache() if request.param == "no borders" else tiled


def keys(frame):
    return sorted((r["sid"], r["begintime"], r["endtime"]) for r in frame.collect())


def test_a_large_security_is_split_over_tiles(bars):
    sizes = [r["count"] for r in bars.groupBy(TILE).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert bars.where("sid = 1").select(TILE).distinct().count() > 8
    split = {r["sid"] for r in split_sids(bars, COLS).collect()}
    tiles = bars.groupBy("sid").agg({TILE: "count"}).count()
    many = {
        r["sid"]
        for r in bars.select("sid", TILE).distinct().groupBy("sid").count().collect()
        if r["count"] > 1
    }
    assert tiles == len(COUNTS) and split == many and 1 in split


@pytest.mark.parametrize("n", [1, 2, 5, 10, 30, 200])
def test_all_windows_across_tile_borders(bars, rows, n):
    found = windows.all_windows(bars, COLS, n)
    assert keys(found) == sorted(fx.windows_of(rows, n))
    assert {r["period"] for r in found.collect()} <= {n}


def test_windows_need_no_shuffle_inside_tiles(spark, rows):
    bars = lay_out(spark.createDataFrame(rows, fx.BARS), COLS, tiles=16)
    for found in (windows.all_windows(bars, COLS, 5), similarity_of_all(bars, [[1.0] * 4, [2.0] * 4], COLS)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == plan.count("FileScan") == 2
    for found in (series.positions(bars, COLS), series.starts(bars, COLS, 5)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan


def test_what_the_border_table_knows(spark, bars, rows):
    known = borders(bars)
    if known is None:
        return
    order = sorted(fx.by_sid(rows).items())
    after = {(sid, r[2]): (sid, i, len(rs)) for sid, rs in order for i, r in enumerate(rs)}
    found = known.rows.collect()
    assert len(found) == bars.select(TILE).distinct().count()
    tiles = bars.select("sid", TILE).distinct().groupBy("sid").count()
    split = {r["sid"] for r in tiles.collect() if r["count"] > 1}
    for r in found:
        sid, i, _ = after[r["lo"]["sid"], r["lo"]["time"]]
        assert r["lo_before"] == i and r["lo_total"] == (len(dict(order)[sid]) if sid in split else None)
        sid, i, total = after[r["hi"]["sid"], r["hi"]["time"]]
        behind = [b["datetime"] for b in r["after"] or []]
        assert behind == [b[2] for b in dict(order)[sid][i + 1 : i + 1 + known.reach]]


def test_a_kept_layout_is_opened_with_its_borders(spark, rows):
    name = fresh_table(spark, "kept")
    written = lay_out(spark.createDataFrame(rows, fx.BARS), COLS, tiles=5, table=name)
    again = open_layout(spark, name)
    assert borders(again) and borders(again).reach == borders(written).reach
    assert borders(again).buckets == borders(written).buckets
    assert keys(windows.all_windows(again, COLS, 30)) == keys(windows.all_windows(written, COLS, 30))
    assert borders(again.where("sid = 1")) is None


@pytest.mark.parametrize("n", [4, 30])
def test_score_of_all_windows_across_tile_borders(bars, rows, n):
    series_of = fx.by_sid(rows)
    pattern = [list(r[3:]) for r in series_of[2][:n]]
    want = {}
    for sid, begin, end in fx.windows_of(rows, n)[:: 7 if n == 30 else 1]:
        x = [list(r[3:]) for r in fx.bars_in(rows, sid, begin, end)]
        want[sid, begin, end] = fx.correlation(x, pattern)
    got = {
        (r["sid"], r["begintime"], r["endtime"]): r["similarity"]
        for r in similarity_of_all(bars, pattern, COLS).collect()
    }
    assert len(got) == len(fx.windows_of(rows, n))
    for key, score in want.items():
        assert got[key] == pytest.approx(score, abs=1e-9)


def test_positions_and_index(spark, bars, rows):
    got = sorted(
        (r["sid"], r["pos"], r["datetime"]) for r in series.positions(bars, COLS).collect()
    )
    want = sorted(
        (sid, i, r[2]) for sid, rs in fx.by_sid(rows).items() for i, r in enumerate(rs)
    )
    assert got == want
    indexed = series.with_index(series.runs(bars, COLS, 5), COLS).collect()
    ordered = sorted(indexed, key=lambda r: r["sample_id"])
    assert [r["sample_id"] for r in ordered] == list(range(len(indexed)))
    assert [(r["sid"], r["begintime"]) for r in ordered] == sorted(
        (s, b) for s, b, _ in fx.windows_of(rows, 5)
    )


def draw_key(window, seed, n, counts):
    sid, begin, _ = window
    micros = (begin - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    text = f"{sid}|{micros}|{seed}"
    u = (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / (counts[sid] / (counts[sid] - n + 1))


@pytest.mark.parametrize("m", [3, 25, 200])
def test_draw_is_the_smallest_weighted_keys(bars, rows, m):
    order = sorted(fx.windows_of(rows, 10), key=lambda w: draw_key(w, 7, 10, COUNTS))
    assert keys(windows.draw_windows(bars, COLS, 10, m, 7)) == sorted(order[:m])


def test_draw_without_enough_below_the_cutoff(bars, rows, monkeypatch):
    monkeypatch.setattr(windows, "CUTOFF_SIGMAS", -2.5)
    order = sorted(fx.windows_of(rows, 10), key=lambda w: draw_key(w, 7, 10, COUNTS))
    assert keys(windows.draw_windows(bars, COLS, 10, 25, 7)) == sorted(order[:25])


def test_draw_more_than_there_are(bars, rows):
    everything = sorted(fx.windows_of(rows, 200))
    assert keys(windows.draw_windows(bars, COLS, 200, 10_000)) == everything


def test_draw_spreads_over_the_parts_of_a_second(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [(1, start + dt.timedelta(milliseconds=i), 1.0, 1.0, 1.0, 1.0) for i in range(20_000)]
    schema = "sid bigint, datetime timestamp_ntz, open double, high double, low double, close double"
    drawn = windows.draw_windows(lay_out(spark.createDataFrame(rows, schema), COLS), COLS, 5, 500)
    found = drawn.collect()
    assert len({r["begintime"] for r in found}) == 500
    seconds = Counter(r["begintime"].second for r in found)
    assert len(seconds) == 20 and max(seconds.values()) < 60


def test_a_large_draw_is_several_tasks(spark):
    rows = spark.range(300_000).selectExpr(
        "id % 5 AS sid", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, id) AS datetime",
        "1D AS open", "1D AS high", "1D AS low", "1D AS close",
    )
    drawn = windows.draw_windows(lay_out(rows, COLS), COLS, 3, 100_000)
    assert drawn.count() == drawn.select(*COLS.window_key).distinct().count() == 100_000
    sizes = [r["count"] for r in drawn.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 60_000


def test_border_runs_of_one_security_are_many_groups(spark):
    rows = spark.range(4_000).selectExpr(
        "1L AS sid", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, id) AS datetime",
        "double(id) AS open", "1D AS high", "1D AS low", "1D AS close",
    )
    tiled = lay_out(rows, COLS, tiles=200)
    for n in (3, 50):  # shorter and longer than a tile
        found = windows.all_windows(tiled, COLS, n)
        assert found.count() == found.distinct().count() == 4_000 - n + 1
        ends = found.selectExpr("timestampdiff(MINUTE, begintime, endtime) AS s").distinct().collect()
        assert [r["s"] for r in ends] == [n - 1]
    plan = series.border_runs(tiled, COLS, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "_stretch" in plan


def test_a_security_is_drawn_as_often_as_it_has_bars():
    """Security 1: 5 bars, one window of 5; security 2: 9 bars, five windows."""
    counts = {1: 5, 2: 9}
    found = fx.windows_of(fx.random_bars(counts), 5)
    draws = 4000
    first = [min(found, key=lambda w: draw_key(w, seed, 5, counts))[0] for seed in range(draws)]
    chance = 5 / 14
    spread = math.sqrt(chance * (1 - chance) / draws)
    assert abs(first.count(1) / draws - chance) < 4 * spread


def test_pattern_is_the_first_window(bars, rows):
    head, tail = windows.split_pattern(windows.all_windows(bars, COLS, 10), COLS)
    first, *rest = sorted(fx.windows_of(rows, 10))
    assert keys(head) == [first]
    assert keys(tail) == rest


def test_search_plans_agree(spark, bars):
    found = windows.all_windows(bars, COLS, 10)
    joined = pattern_search(bars, found, COLS).collect()
    assert len(joined) == 10
    assert [r["rank"] for r in joined] == list(range(1, 11))
    for other in ({"grouped": True}, {"every_window": True}):
        rows = pattern_search(bars, found, COLS, **other).collect()
        assert [r[2:] for r in rows] == [r[2:] for r in joined]
        assert [r[1] for r in rows] == pytest.approx([r[1] for r in joined])


def test_tile_count():
    assert tile_count(0, 8) == 1
    assert tile_count(8_261, 200) == 8
    assert tile_count(533_473, 8) == 32
    assert tile_count(10**12, 20_000) == 200_000


@pytest.mark.parametrize("tiles", [1, 12])
def test_several_exchanges_at_one_time(spark, tiles):
    """One window per start time; a score only if its time range holds just its bars."""
    n = 4
    rows = fx.random_bars({1: 80, 2: 30})
    rows += [(sid, "Y", when, *(p * 1.1 for p in prices)) for sid, _, when, *prices in rows[::3]]
    bars = lay_out(spark.createDataFrame(rows, fx.BARS), COLS, tiles=tiles)
    want = {}
    for sid, series_rows in fx.by_sid(rows).items():
        for i in range(len(series_rows) - n + 1):
            begin, end = series_rows[i][2], series_rows[i + n - 1][2]
            if not i or series_rows[i - 1][2] != begin:
                want[sid, begin] = end
    found = windows.all_windows(bars, COLS, n)
    assert keys(found) == sorted((s, b, e) for (s, b), e in want.items())
    assert keys(windows.all_windows(bars.select("*"), COLS, n)) == keys(found)
    pattern = [list(r[3:]) for r in fx.by_sid(rows)[2][3 : 3 + n]]
    swept = similarity_of_all(bars, pattern, COLS).collect()
    joined = similarity(bars, found, pattern, COLS).collect()
    order = lambda r: r[:3]
    assert sum(r["similarity"] is None for r in swept) > 5
    for a, b in zip(sorted(swept, key=order), sorted(joined, key=order), strict=True):
        assert a[:3] == b[:3]
        score = b["similarity"]
        assert a["similarity"] == (None if score is None else pytest.approx(score))


def test_runs_longer_than_a_batch(spark, bars, rows):
    pattern = [list(r[3:]) for r in fx.by_sid(rows)[2][:30]]
    want = sorted(map(tuple, similarity_of_all(bars, pattern, COLS).collect()))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, 7)
    try:
        got = sorted(map(tuple, similarity_of_all(bars, pattern, COLS).collect()))
    finally:
        spark.conf.unset(setting)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
