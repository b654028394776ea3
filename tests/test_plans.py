"""Physical-plan properties of the registered queries."""

import contextlib
import io
import re

import pytest

from hourwise.plans.catalog import query_functions

def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def qs():
    return query_functions()


def test_no_python_udfs_anywhere(spark, sf0001, qs):
    for key, fn in qs.items():
        text = plan_text(fn(spark, sf0001))
        assert not re.search("PythonUDF|EvalPython|InPandas|InArrow|ExistingRDD", text), key


def executed_plan(df):
    """The plan as run, with what adaptive execution made of it."""
    df.write.format("noop").mode("overwrite").save()
    return plan_text(df)


def test_quantiles_are_a_projection(spark, sf0001, qs):
    """NTILE by selection: no shuffle, no sort and no staged copy of the readings."""
    text = plan_text(qs["ntile_quartiles_scaled"](spark, sf0001))
    assert "BroadcastHashJoin" in text and "events.parquet" in text and "hourwise-stage" not in text
    assert not re.search(r"Exchange(?!Mode)\b(?! *\()|rangepartitioning|hashpartitioning|Window|SortMergeJoin|\bSort\b", text.replace("BroadcastExchange", ""))


def test_moving_window_shuffles_readings_once(spark, sf0001):
    from hourwise.operators import windows
    from hourwise.sources.readings import from_events

    r = from_events(spark, sf0001)
    df = windows.moving_window(r, ["traffic_time", "record_id"], "traffic_count", 1, 1, buckets=8)
    df = df.select("traffic_time", "traffic_count", "moving")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tree = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tree.count("Exchange hashpartitioning") == 1 and tree.count("- Window") == 1 and tree.count("FileScan") == 1
    assert "rangepartitioning" not in tree and "SinglePartition" not in tree and "hourwise-stage" not in tree


TOP_K_KEYS = ["preview_first10", "enriched_preview", "top_spikes", "daily_totals_top20", "ntile_quartiles",
              "moving_3row_avg", "vw_daily_summary_top10", "vw_spike_events_top15", "exec_top_days",
              "exec_low_days", "exec_spikes", "insight_maintenance"]


@pytest.mark.parametrize("key", TOP_K_KEYS)
def test_top_k_reports_never_sort_globally(spark, sf0001, qs, key):
    """A LIMIT report must plan a per-task top-k, never a range-partitioned global sort."""
    text = plan_text(qs[key](spark, sf0001))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


@pytest.mark.parametrize("key", ["daily_report_hours", "range_report_summary", "range_report_daily"])
def test_date_filters_reach_the_scan(spark, sf0001, qs, key):
    df = qs[key](spark, sf0001)
    text = plan_text(df)
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", text)
    assert any("GreaterThanOrEqual" in p and "LessThan" in p for p in pushed), pushed


def test_scan_reads_only_needed_columns(spark, sf0001, qs):
    text = plan_text(qs["hourly_pattern"](spark, sf0001))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert schemas and all("props" not in s and "user_id" not in s for s in schemas)
