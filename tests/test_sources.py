import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from windowmatch.config import SearchColumns
from windowmatch.functions.times import parse_time, strptime_regex
from windowmatch.operators import scan
from windowmatch.operators.upsert import concat, upsert
from windowmatch.plans import jobs
from windowmatch.sources import bar_files, lines, tables

COLS = SearchColumns()


# The golden lines and counts of the next two tests.


def test_lines_in_order(spark, tmp_path):
    path = tmp_path / "test.txt"
    path.write_text("this is a test\nmore test\none more line\n")
    frame = lines.read_lines(spark, str(path))
    assert [r["value"] for r in frame.collect()] == ["this is a test", "more test", "one more line"]
    assert scan.row_count(frame).first()["n_rows"] == 3


@pytest.fixture
def namespace(spark, tmp_path):
    name = "market_test"
    tables.reset_namespace(spark, name, str(tmp_path / "warehouse"))
    yield name
    spark.sql("USE default")
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_load_and_count(spark, tmp_path, namespace):
    path = tmp_path / "kv.txt"
    path.write_text("".join(f"{i}\x01val_{i}\n" for i in range(498)) + "\\N\x01\\N\nx\x01y\n")
    spark.sql("CREATE TABLE src (key INT, value STRING) USING parquet")
    tables.load_data(spark, str(path), "src")
    assert spark.sql("SELECT COUNT(1) FROM src").first()[0] == 500
    odd = spark.sql("SELECT value FROM src WHERE key IS NULL").collect()
    assert sorted(r["value"] or "" for r in odd) == ["", "y"]
    tables.load_data(spark, str(path), "src")
    assert spark.table("src").count() == 1000


def test_namespace_is_emptied(spark, namespace):
    tables.create_windows_table(spark, "windows10")
    tables.reset_namespace(spark, namespace)
    assert spark.catalog.listTables(namespace) == []


def test_export_loads_in_key_then_name_order(spark, tmp_path, namespace):
    path = tmp_path / "bars.csv"
    path.write_text("7,2020-01-02 00:00:00,X,4.0,2.0,3.0,1.0,0.5,\n")
    tables.create_bars_table(spark, "bars")
    tables.load_bars(spark, str(path), "bars")
    got = tables.read_bars(spark, "bars").first().asDict()
    assert got == {
        "sid": 7, "exchangeCD": "X", "datetime": dt.datetime(2020, 1, 2), "open": 1.0,
        "high": 2.0, "low": 3.0, "close": 4.0, "pre_close": 0.5, "volume": None,
    }


def bar(sid, when, price, exchange="X"):
    return (sid, exchange, when, price, price, price, price, None, 1.0)


def test_upsert_rewrites_only_changed_months(spark, namespace):
    tables.create_bars_table(spark, "bars")

    def put(*rows):
        tables.upsert_into(spark, "bars", spark.createDataFrame(rows, bar_files.BARS_SCHEMA), COLS)
        return {f for f in spark.table("bars").inputFiles()}

    before = put(*(bar(1, dt.datetime(2019, m, 1), 1.0) for m in (1, 2, 3)))
    added = put(bar(2, dt.datetime(2019, 1, 1), 5.0))
    assert before < added
    after = put(
        bar(1, dt.datetime(2019, 2, 1), 2.0),
        bar(1, dt.datetime(2019, 2, 1), 3.0, "Y"),
        bar(2, dt.datetime(2019, 4, 1), 4.0),
    )
    assert {f for f in added if "bar_month=201902" not in f} < after
    assert not any("bar_month=201902" in f for f in added & after)
    got = sorted(
        (r["sid"], r["datetime"].month, r["exchangeCD"], r["open"])
        for r in tables.read_bars(spark, "bars").collect()
    )
    assert got == [
        (1, 1, "X", 1.0), (1, 2, "X", 2.0), (1, 2, "Y", 3.0), (1, 3, "X", 1.0),
        (2, 1, "X", 5.0), (2, 4, "X", 4.0),
    ]


def test_upsert_keeps_the_last_version(spark):
    base = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k int, v double")
    delta = spark.createDataFrame([(2, 1.0, 2), (2, 9.0, 1), (3, 3.0, 1)], "k int, v double, seq int")
    got = sorted(map(tuple, upsert(base, delta, ["k"], "seq").collect()))
    assert got == [(1, 10.0), (2, 1.0), (3, 3.0)]


def test_concat_matches_names(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2, 0.5)], "b string, a int, c double")
    assert sorted(map(tuple, concat([a, b]).select("a", "b", "c").collect())) == [
        (1, "x", None), (2, "y", 0.5),
    ]


def test_windows_table_is_replaced(spark, namespace):
    cols = COLS.with_table("bars", namespace)
    one = tables.windows_from_rows(spark, [(1, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 9), 3)])
    two = tables.windows_from_rows(spark, [(2, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 9), 3)])
    assert tables.replace_windows(one, 3, cols) == f"{namespace}.windows3"
    tables.replace_windows(two, 3, cols)
    assert [r["sid"] for r in spark.table(f"{namespace}.windows3").collect()] == [2]


HEADER = "datetime,PRE_CLOSE,OPEN,HIGH,LOW,CLOSE,VOLUME,TURNOVER\n"


@pytest.fixture
def bar_dir(tmp_path):
    (tmp_path / "600000.XSHG.csv").write_text(
        HEADER
        + "2020-01-02 00:00:00,9,10,12,8,11,100,1\n"
        + "\n"
        + "2020/1/3,11,11,13,9,12,,1\n"
        + "2020-01-04T09:30:00.5,11,11,13,9,12,NaN,1\n"
    )
    (tmp_path / "1.XSHE.day.csv").write_text(HEADER + "2020-01-02 00:00:00,1,2,3,4,5,6,7\n")
    (tmp_path / "index.XSHE.csv").write_text(HEADER + "2020-01-02 00:00:00,1,2,3,4,5,6,7\n")
    (tmp_path / "2.XSHE.csv").write_text(
        HEADER + "some day,1,2,3,4,5,6,7\n2020-01-05 00:00:00,1,two,3,4,5,6,7\n"
    )
    (tmp_path / "3.XSHE.txt").write_text("not bars\n")
    return str(tmp_path)


def test_ingest(spark, bar_dir):
    bars, rejects = bar_files.ingest(spark, bar_dir)
    bars = bars.drop(bar_files.SEQ)
    assert bars.schema == bar_files.BARS_SCHEMA
    got = sorted(map(tuple, bars.collect()))
    assert got == [
        (1, "XSHE", dt.datetime(2020, 1, 2), 2.0, 3.0, 4.0, 5.0, 1.0, 6.0),
        (600000, "XSHG", dt.datetime(2020, 1, 2), 10.0, 12.0, 8.0, 11.0, 9.0, 100.0),
        (600000, "XSHG", dt.datetime(2020, 1, 3), 11.0, 13.0, 9.0, 12.0, 11.0, None),
        (600000, "XSHG", dt.datetime(2020, 1, 4, 9, 30, 0, 500000), 11.0, 13.0, 9.0, 12.0, 11.0, None),
    ]
    assert sorted((r["file_name"], r["problem"]) for r in rejects.collect()) == [
        ("2.XSHE.csv", "number"), ("2.XSHE.csv", "time"), ("index.XSHE.csv", "file name"),
    ]


def test_strict_ingest_fails(spark, bar_dir):
    bars, _ = bar_files.ingest(spark, bar_dir, strict=True)
    for action in (bars.collect, bars.count):
        with pytest.raises(Exception, match="file name|time|number"):
            action()


def test_other_separator_time_column_and_format(spark, tmp_path):
    (tmp_path / "5.A.csv").write_text(
        "OPEN;HIGH;LOW;CLOSE;PRE_CLOSE;VOLUME;day\n1;2;3;4;5;6;31.12.2019 09h15\n"
    )
    bars, rejects = bar_files.ingest(
        spark, str(tmp_path), sep=";", time_column="day", time_format="%d.%m.%Y %Hh%M"
    )
    assert bars.first()["datetime"] == dt.datetime(2019, 12, 31, 9, 15)
    assert rejects.count() == 0


def test_a_file_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "1.A.csv").write_text(HEADER + "2020-01-02 00:00:00,1,2,3,4,5,6,7\n")
    (tmp_path / "2.A.csv").write_text(
        "datetime,OPEN,PRE_CLOSE,HIGH,LOW,CLOSE,VOLUME,TURNOVER\n2020-01-02 00:00:00,1,2,3,4,5,6,7\n"
    )
    bars, _ = bar_files.ingest(spark, str(tmp_path))
    with pytest.raises(Exception, match="header"):
        bars.collect()
    bars, rejects = bar_files.ingest(spark, str(tmp_path), mixed=True)
    got = sorted((r["sid"], r["pre_close"], r["open"], r["volume"]) for r in bars.collect())
    assert got == [(1, 1.0, 2.0, 6.0), (2, 2.0, 1.0, 6.0)]
    assert rejects.count() == 0


def test_mixed_ingest_equals_plain_ingest(spark, bar_dir):
    plain, rejected = bar_files.ingest(spark, bar_dir)
    mixed, also_rejected = bar_files.ingest(spark, bar_dir, mixed=True)
    columns = bar_files.BARS_SCHEMA.fieldNames()
    assert sorted(mixed.select(columns).collect(), key=repr) == sorted(plain.select(columns).collect(), key=repr)
    assert also_rejected.count() == rejected.count() == 3


def test_mixed_files_of_one_name_and_without_a_time(spark, tmp_path):
    for folder, header in (("a", "datetime,OPEN,HIGH,LOW,CLOSE"), ("b", "CLOSE,LOW,HIGH,OPEN,datetime")):
        (tmp_path / folder).mkdir()
        cells = ["2020-01-02 00:00:00", "1", "4", "0", "2"]
        line = ",".join(cells if folder == "a" else cells[::-1])
        (tmp_path / folder / "7.X.csv").write_text(f"{header}\n{line}\n")
    (tmp_path / "a" / "8.X.csv").write_text("day,OPEN\n2020-01-02,1\ndatetime,3\n")
    for i in range(150):
        (tmp_path / "b" / f"{100 + i}.Y.csv").write_text(f"OPEN,extra{i},datetime\n{i},x,2020-01-03 00:00:00\n")
    bars, rejects = bar_files.ingest(spark, [str(tmp_path / "a"), str(tmp_path / "b")], mixed=True)
    got = [(r["sid"], r["open"], r["high"], r["low"], r["close"]) for r in bars.collect()]
    assert sorted(got[:0] + [g for g in got if g[0] == 7]) == [(7, 1.0, 4.0, 0.0, 2.0)] * 2
    assert sorted((g[0], g[1]) for g in got if g[0] != 7) == [(100 + i, float(i)) for i in range(150)]
    assert [(r["file_name"], r["problem"]) for r in rejects.collect()] == [("8.X.csv", "time")] * 2


def test_the_last_row_of_a_key_counts(spark, tmp_path, namespace):
    (tmp_path / "7.X.csv").write_text(HEADER + "2020-01-02 00:00:00,1,9,9,9,9,6,7\n2020-01-02 00:00:00,1,1,1,1,1,6,7\n")
    jobs.import_bars(spark, str(tmp_path), "bars")
    assert [r["open"] for r in tables.read_bars(spark, "bars").collect()] == [1.0]


def test_unchanged_months_keep_their_files(spark, namespace):
    day = dt.datetime
    rows = [bar(1, day(2020, 1, 2), 1.0), bar(1, day(2020, 2, 3), 2.0), bar(2, day(2020, 2, 3), 3.0)]
    tables.create_bars_table(spark, "bars")
    before = None
    for _ in range(2):
        tables.upsert_into(spark, "bars", spark.createDataFrame(rows, bar_files.BARS_SCHEMA))
        files = sorted(spark.table("bars").inputFiles())
        assert before in (None, files)
        before = files
    changed = [bar(1, day(2020, 2, 3), 5.0), bar(3, day(2020, 1, 2), 6.0), bar(1, day(2020, 1, 2), 1.0)]
    tables.upsert_into(spark, "bars", spark.createDataFrame(changed, bar_files.BARS_SCHEMA))
    after = set(spark.table("bars").inputFiles())
    assert {f for f in before if "bar_month=202001" in f} <= after
    assert not {f for f in before if "bar_month=202002" in f} & after
    got = sorted((r["sid"], r["datetime"].month, r["open"]) for r in tables.read_bars(spark, "bars").collect())
    assert got == [(1, 1, 1.0), (1, 2, 5.0), (2, 2, 3.0), (3, 1, 6.0)]


def test_bulk_load_rejects_what_does_not_fit(spark, tmp_path, namespace):
    path = tmp_path / "bars.csv"
    path.write_text("x,2020-01-02 00:00:00,X,4,2,3,1,0.5,\n7,,X,4,2,3,1,0.5,\n7,2020-01-02 00:00:00,X,4,2,3,oops,1,1\n"
                    "7,2020-01-02 00:00:00,X,4,2,3,8,1,1\n7,2020-01-02 00:00:00,X,4,2,3,1,0.5,\n")
    tables.create_bars_table(spark, "bars")
    rejects = tables.load_bars(spark, str(path), "bars")
    assert sorted(r["problem"] for r in rejects.collect()) == ["datetime", "open", "sid"]
    assert [(r["sid"], r["open"]) for r in tables.read_bars(spark, "bars").collect()] == [(7, 1.0)]


def test_only_the_months_of_a_range_are_read(spark, namespace):
    tables.create_bars_table(spark, "bars")
    rows = [bar(1, dt.datetime(2020, m, 2), float(m)) for m in range(1, 7)]
    tables.upsert_into(spark, "bars", spark.createDataFrame(rows, bar_files.BARS_SCHEMA))
    some = tables.read_bars(spark, "bars", dt.datetime(2020, 2, 1), dt.datetime(2020, 3, 31))
    assert sorted(r["open"] for r in some.collect()) == [2.0, 3.0]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bar_month" in plan


TIMES = [
    # the format, the text, what it is
    ("%d/%m/%Y", "5/3/2020", (2020, 3, 5)),
    ("%d/%m/%Y", "15/3/2020", (2020, 3, 15)),
    ("%m/%d/%Y", "15/3/2020", None),
    ("%y%m%d", "990315", (1999, 3, 15)),
    ("%y%m%d", "200315", (2020, 3, 15)),
    ("%Y-%m-%d %H:%M:%S", "2020-03-08 02:30:00", (2020, 3, 8, 2, 30)),
    ("%Y-%m-%d %H:%M:%S", "2020-1-5 1:2:3", (2020, 1, 5, 1, 2, 3)),
    ("%Y-%m-%d %H:%M:%S", "2020-01-05T10:00:00Z", (2020, 1, 5, 10)),
    ("%Y-%m-%d %H:%M:%S", "2020-01-05 10:00:00+08:00", (2020, 1, 5, 2)),
    ("%Y-%m-%d %H:%M:%S", "5-Jan-2020", (2020, 1, 5)),
    ("%Y-%m-%d %H:%M:%S", "January 5, 2020", (2020, 1, 5)),
    ("%Y-%m-%d %H:%M:%S", "Jan 5, 2020 10:00", (2020, 1, 5, 10)),
    ("%Y-%m-%d %H:%M:%S", "20200105 10:00", (2020, 1, 5, 10)),
    ("%Y-%m-%d %H:%M:%S", "2020.01.05", (2020, 1, 5)),
    ("%Y-%m-%d %H:%M:%S", "1/5/2020 12:04 AM", (2020, 1, 5, 0, 4)),
    ("%Y-%m-%d %H:%M:%S", "2020-01-05 10:00:00.25", (2020, 1, 5, 10, 0, 0, 250_000)),
    ("%Y-%m-%d %H:%M:%S.%f", "2020-01-05 10:00:00.000007", (2020, 1, 5, 10, 0, 0, 7)),
    ("%b %d %Y %I:%M %p", "mar 5 2020 12:30 pm", (2020, 3, 5, 12, 30)),
    ("%Y%j", "2020366", (2020, 12, 31)),
    ("%Y-%j", "2021-366", None),
    ("%Y-%j", "2021-365", (2021, 12, 31)),
    ("%Y-%j", "2021-60", (2021, 3, 1)),
    ("%Y-%j", "31/12/2020", (2020, 12, 31)),
    ("%Y-%j", "3/12/2020", (2020, 3, 12)),
    ("%Y-%m-%d %H:%M:%S", "Sun Jan 5 10:00:00 2020", (2020, 1, 5, 10)),
    ("%Y-%m-%d %H:%M:%S", "Sun Jan  5 23:59:58 2020", (2020, 1, 5, 23, 59, 58)),
    ("%Y-%m-%d %H:%M:%S", "2020-01-05 10am", (2020, 1, 5, 10)),
    ("%Y-%m-%d %H:%M:%S", "2020-01-05 12 pm", (2020, 1, 5, 12)),
    ("%Y-%m-%d %H:%M:%S", "20200105100000", (2020, 1, 5, 10)),
    ("%Y-%m-%d %H:%M:%S", "20200105 100001", (2020, 1, 5, 10, 0, 1)),
    ("%Y-%m-%d %H:%M:%S", "Jan 2020", (2020, 1, 1)),
    ("%Y-%m-%d %H:%M:%S", "2020-Jan", (2020, 1, 1)),
    ("%Y-%m-%d %H:%M:%S", "Sunday, 5th January 2020 1:02", (2020, 1, 5, 1, 2)),
    ("%Y-%m-%d %H:%M:%S", "31/12/2020", None),
    ("%Y-%m-%d %H:%M:%S", "2020-01-05 10:00:00\n", (2020, 1, 5, 10)),
    ("%Y-%m-%d", "2020-01-05 25:00", None),
    ("%Y-%m-%d", "2020-01-05 10", None),
    ("%Y-%m-%dT%H:%M:%S%z", "2020-01-05T10:00:00-0530", (2020, 1, 5, 15, 30)),
    ("%Y-%m-%d", "2020-02-30", None),
    ("%Y-%m-%d", "rubbish", None),
    ("%Y-%m-%d", "", None),
    ("%Y-%m-%d", None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for form in {f for f, _, _ in TIMES}:
            texts = [(t,) for f, t, _ in TIMES if f == form]
            got = spark.createDataFrame(texts, "t string").select(parse_time(F.col("t"), form)).collect()
            want = [w and dt.datetime(*w) for f, _, w in TIMES if f == form]
            assert [r[0] for r in got] == want, form
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(ValueError):
        strptime_regex("%Q")


def test_relational_operators(spark):
    rows = [bar(s, dt.datetime(2020, 1, d), float(d)) for s in (1, 2, 1500) for d in (1, 2, 3)]
    bars = spark.createDataFrame(rows, bar_files.BARS_SCHEMA)
    assert scan.by_sid(bars, COLS, 2).count() == 3
    assert scan.by_time(bars, COLS, "2020-01-02", dt.datetime(2020, 1, 3)).count() == 6
    windows = tables.windows_from_rows(spark, [(1, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2), 2)] * 2)
    assert scan.of_sampled_sids(bars, windows, COLS).count() == 3
    assert sorted(map(tuple, scan.sid_lists(bars, COLS).collect())) == [(0, "1,2"), (1, "1500")]
    assert scan.first_windows(windows, COLS, 1).count() == 1


def test_config():
    cols = COLS.with_match("close").with_table("bars", "market")
    assert cols.match == ("close",) and cols.qualified_table == "market.bars"
    assert cols.describe() == "market.bars: windows of close by sid over datetime"
    assert COLS.describe().startswith("no table: windows of open, high, low, close")
    with pytest.raises(ValueError):
        COLS.with_match()
    with pytest.raises(ValueError):
        COLS.qualified_table


def test_times_of_several_columns_are_parsed_once_in_one_pass(spark):
    rows = spark.createDataFrame([("2020-01-05 10:00:00", "5 January 2020"), ("x", "y")], "a string, b string")
    times = rows.select(parse_time(F.col("a"), "%Y-%m-%d %H:%M:%S").alias("a"), parse_time(F.col("b"), "%d/%m/%Y").alias("b"))
    found = times.where("a is not null or b is not null")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "regexp" not in plan
    assert [tuple(r) for r in found.collect()] == [(dt.datetime(2020, 1, 5, 10), dt.datetime(2020, 1, 5))]


def test_lines_of_mixed_files_are_cut_once(spark, tmp_path):
    (tmp_path / "1.a.csv").write_text("datetime,OPEN,HIGH\n2020-01-05,1,2\n")
    (tmp_path / "2.a.csv").write_text("HIGH,datetime\n4,2020-01-06\n")
    raw = bar_files.read_mixed_bar_files(spark, str(tmp_path))
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    # the value and the header of each line; the headers themselves were found before
    assert plan.count("from_csv") == 2 and "min_by" not in plan
    rows = raw.select("file_name", "datetime", "OPEN", "HIGH").orderBy("file_name").collect()
    assert [tuple(r) for r in rows] == [("1.a.csv", "2020-01-05", "1", "2"), ("2.a.csv", "2020-01-06", None, "4")]


def test_bar_files_are_written_by_the_tasks_as_spark_would(spark, tmp_path):
    rows = [(i, "A B" if i % 2 else "a:b%{", dt.datetime(1999, 1, 1) + dt.timedelta(days=d, microseconds=d), float(d), 1e7, None)
            for i in range(40) for d in range(3)]
    rows.append((None, "X", dt.datetime(2020, 1, 1), 1.0, 2.0, 3.0))
    bars = spark.createDataFrame(rows, "sid int, exchangeCD string, datetime timestamp_ntz, open double, volume double, pre_close double")
    bars = bars.withColumns({c: F.col("open") / 3 for c in ("high", "low", "close")})
    for sep in (",", "-"):
        ours, theirs = str(tmp_path / f"ours{ord(sep)}"), str(tmp_path / f"theirs{ord(sep)}")
        bar_files.write_bar_files(bars, ours, sep=sep)
        raw = bar_files.read_bar_files(spark, ours, sep=sep, name_column="file").drop(bar_files.SEQ)
        raw.withColumnRenamed("file_name", "file").write.partitionBy("file").option("header", True).option("sep", sep).csv(theirs)

        def held(top):
            files = [f for f in Path(top).rglob("*.csv") if f.is_file()]
            return sorted((f.parent.name, text) for f in files for text in f.read_text().splitlines())

        assert held(ours) == held(theirs) and len(held(ours)) == 41 + len(rows)
        # Spark's writer leaves a sum beside each file
        assert not list(Path(ours).rglob("*.crc")) and not list(Path(ours).rglob(".[0-9a-f]*"))
        with pytest.raises(FileExistsError):
            bar_files.write_bar_files(bars, ours, sep=sep)
    found, rejects = bar_files.parse_bars(bar_files.read_bar_files(spark, str(tmp_path / "ours44"), name_column="file"))
    assert found.count() == len(rows) - 1 and rejects.count() == 1


def test_a_name_with_many_rows_is_several_files_and_no_rows_are_none(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).select(F.lit("7.X.csv").alias("file"), F.format_string("%06d", "id").alias("at"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        bar_files.write_named_files(rows, str(tmp_path / "many"), "file")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "many" / "file=7.X.csv").iterdir())
    assert len(files) > 1 and {f.read_text().splitlines()[0] for f in files} == {"at,id"}
    assert [line for f in files for line in f.read_text().splitlines()[1:]] == [f"{i:06d},{i}" for i in range(20_000)]
    bar_files.write_named_files(rows.where("false"), str(tmp_path / "none"), "file")
    assert not list((tmp_path / "none").iterdir())
