"""What the plans of the registered queries read, move and send around."""

import pytest
from test_queries import own

import __spark_entry__ as registered
from windowmatch.operators import range_join, scan

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    frame = registered.queries()[name](spark, SF_DIR)
    return frame._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "bars_by_sid")
    assert "EqualTo(sid,7)" in text
    assert "volume" not in text.split("ReadSchema")[1].splitlines()[0]
    text = plan(spark, "bars_time_range")
    assert "GreaterThanOrEqual(datetime,1996-01-01" in text
    assert "LessThanOrEqual(datetime,1997-06-01" in text
    months = next(line for line in text.splitlines() if line.startswith("PartitionFilters"))
    assert "bar_month" in months and ">= 199601" in months and "<= 199706" in months
    text = plan(spark, "row_count")
    assert "ReadSchema: struct<>" in text


def test_range_of_the_windows_reaches_the_scan_of_the_bars(spark):
    text = plan(spark, "window_matrix")
    assert "LessThanOrEqual(datetime,2001-11-01" in text


@pytest.mark.parametrize("name", sorted(own()))
def test_no_query_has_a_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["bars_scan", "bars_by_sid", "line_scan", "normalize", "dist_corr"])
def test_rows_stay_where_they_are(spark, name):
    """No exchange but those of the bars next to tile borders."""
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") <= 2
    if name in ("bars_scan", "bars_by_sid", "line_scan"):
        assert "Exchange" not in text


def test_only_the_months_of_the_windows_are_read(spark):
    """The bars of a pattern, and a join with windows, name the months of their range to the scan."""
    bars = registered.stored_bars(spark, SF_DIR)
    found = registered.windows_of(spark, SF_DIR).where("endtime < timestamp_ntz'1997-01-01'")
    joined = range_join.matched_bars(bars, found, registered.COLS)
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bar_month" in text and "<= 199612)" in text
    near = scan.by_sid(scan.by_time(bars, registered.COLS, "1996-01-01", "1996-09-30"), registered.COLS, 3)
    assert "bar_month" in near._jdf.queryExecution().executedPlan().toString()
    assert near.columns == bars.columns
    assert near.count() == bars.where("sid = 3 AND datetime BETWEEN '1996-01-01' AND '1996-09-30'").count()
