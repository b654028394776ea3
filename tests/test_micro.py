"""Hand-computed goldens on the micro table M with the original's constants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourwise.config import REFERENCE
from hourwise.operators import insights, summaries, trends
from hourwise.operators.enrich import enrich
from hourwise.plans import reports, views
from micro import micro_readings

CFG = REFERENCE.with_(year_safe=True)


@pytest.fixture(scope="module")
def r(spark):
    return enrich(micro_readings(spark), CFG).cache()


def by_id(df, col):
    return {row["record_id"]: row[col] for row in df.select("record_id", col).collect()}


def test_schema(r):
    assert [(f.name, f.dataType.simpleString()) for f in r.schema.fields] == [
        ("record_id", "bigint"), ("traffic_time", "timestamp_ntz"), ("traffic_count", "int"),
        ("traffic_year", "int"), ("traffic_month", "int"), ("month_name", "string"), ("iso_year", "int"),
        ("traffic_week", "int"), ("traffic_date", "date"), ("hour_of_day", "int"), ("day_of_week", "int"),
        ("day_name", "string"), ("is_weekend", "int"), ("is_business_hr", "int"),
        ("traffic_category", "string"), ("is_spike", "int")]


def test_band_edges(r):
    cat = by_id(r, "traffic_category")
    assert [cat[i] for i in (5, 6, 8, 9, 10, 3)] == ["Low", "Medium", "Medium", "High", "High", "Peak"]


def test_spike_is_strictly_above_fixed_threshold(r):
    spikes = by_id(r, "is_spike")
    assert [i for i, s in sorted(spikes.items()) if s] == [12]


def test_business_hours_inclusive(r):
    bh = by_id(r, "is_business_hr")
    assert (bh[8], bh[9]) == (1, 0)


def test_calendar_names(r):
    row = r.filter("record_id = 1").first()
    assert (row.month_name, row.day_name, row.day_of_week, row.is_weekend) == ("December", "Thursday", 5, 0)
    sun = r.filter("record_id = 4").first()
    assert (sun.day_name, sun.day_of_week, sun.is_weekend) == ("Sunday", 1, 1)


def test_iso_week_53_spans_year_end(r):
    w = summaries.weekly_totals(r, CFG).collect()
    first = w[0]
    assert (first.iso_year, first.iso_week, first.total_traffic, first.readings) == (2020, 53, 21099, 6)
    assert first.week_starts == dt.date(2020, 12, 31)


def test_year_safe_monthly_growth(r):
    m = summaries.monthly_summary(r, CFG).collect()
    assert [(x.traffic_year, x.traffic_month, x.total_monthly_traffic) for x in m] == [(2020, 12, 100), (2021, 1, 114096)]
    assert m[0].mom_growth_pct is None and m[1].mom_growth_pct == 113996.0


def test_lag_uses_previous_existing_day(r):
    rows = {x.traffic_date: x for x in trends.day_over_day(r, CFG).collect()}
    assert rows[dt.date(2021, 1, 3)].prev_day_total == 20000


def test_rolling_average_counts_existing_days(r):
    rows = {x.traffic_date: x for x in trends.rolling_7day_avg(r, CFG).collect()}
    assert rows[dt.date(2021, 1, 11)].rolling_7day_avg == 19032.7


def test_zero_mean_hour_is_volatile(r):
    h3 = insights.consistency_score(r, CFG).filter("hour_of_day = 3").first()
    assert (h3.avg_traffic, h3.coefficient_of_variation, h3.traffic_stability) == (0.0, None, "Volatile")


def test_weekend_ratio_null_on_zero_weekday_mean(r):
    rows = {x.hour_of_day: x for x in insights.weekend_profile(r, CFG).collect()}
    assert rows[3].weekend_as_pct_of_weekday is None
    assert rows[10].weekday_avg is None


def test_report_for_missing_day(r):
    s = reports.day_summary(r, CFG, dt.date(2021, 1, 2)).first()
    assert (s.total_readings, s.total_traffic, s.traffic_rank_among_all_days) == (0, None, 1)


def test_report_rank_matches_rank_window(r):
    s = reports.day_summary(r, CFG, "2021-01-03").first()
    assert s.traffic_rank_among_all_days == 5
    assert (s.day_of_week, s.month, s.total_readings, s.total_traffic) == ("Sunday", "January", 3, 999)


def test_maintenance_windows_truncate_at_end(r):
    got = [(x.window_start, x.total_4hr_window_avg) for x in insights.maintenance_window(r, CFG).collect()]
    assert got == [(23, 100.0), (21, 25874.5), (18, 30874.5), (17, 35873.5), (0, 38549.3)]


def test_maintenance_wrap_option(r):
    got = {x.window_start: x.total_4hr_window_avg
           for x in insights.maintenance_window(r, CFG, n=24, wrap=True).collect()}
    # 23 -> 23, 0, 3, 10 when the window continues past midnight
    assert got[23] == round(100 + 0 + 0 + (499 + 500 + 19999) / 3, 1)


def test_spike_view_uses_configured_z(r):
    z = views.spike_events(r, CFG).first()
    assert z.record_id == 12 and z.z_score == round((31550 - 8591.0) / 11479.0, 2)


def test_hour_labels(r):
    labels = {x.hour_of_day: x.hour_label for x in summaries.hourly_pattern(r, CFG).collect()}
    assert labels[0] == "12 AM (Midnight)" and labels[10] == "10 AM" and labels[21] == "9 PM"
    short = {x.hour_of_day: x.hour_label for x in views.hourly_pattern_view(r, CFG).collect()}
    assert short[0] == "12 AM" and short[17] == "5 PM"


def test_text_bar(r):
    bars = {x.hour_of_day: x.traffic_bar for x in summaries.hourly_pattern(r, CFG).collect()}
    assert bars[11] == "█" * 63 and bars[3] == ""


def test_cumulative_share_uses_configured_total(r):
    last = trends.cumulative_total(r, CFG).collect()[-1]
    assert last.cumulative_total == 114196
    assert last.pct_of_total_reached == round(114196 * 100.0 / 23995560, 2)


def test_cumulative_share_computed_total_reaches_100(r):
    last = trends.cumulative_total(r, CFG.with_(grand_total=None)).collect()[-1]
    assert last.pct_of_total_reached == 100.0


def test_category_order_and_counts(r):
    rows = summaries.category_distribution(r, CFG).collect()
    assert [x.traffic_category for x in rows] == ["Peak", "High", "Medium", "Low"]
    assert sum(x.record_count for x in rows) == 12


def test_alerts_keep_only_spike_days(r):
    rows = insights.anomaly_calendar(r, CFG).collect()
    assert [(x.traffic_date, x.spike_hours, x.alert_level) for x in rows] == [(dt.date(2021, 1, 11), 1, "ELEVATED")]


def test_computed_threshold_mode(spark):
    r2 = enrich(micro_readings(spark), CFG.with_(spike_threshold=None, spike_k=1.0))
    vals = [x[2] for x in __import__("micro").ROWS]
    mean = sum(vals) / len(vals)
    std = (sum((v - mean) ** 2 for v in vals) / len(vals)) ** 0.5
    expect = sorted(i for i, _, v in __import__("micro").ROWS if v > mean + std)
    got = sorted(x.record_id for x in r2.filter(F.col("is_spike") == 1).collect())
    assert got == expect


def test_parity_mode_without_year_keys(r):
    cfg = CFG.with_(year_safe=False)
    m = summaries.monthly_summary(r, cfg)
    assert m.columns[:2] == ["traffic_month", "month_name"]
    # Months sort by number only: January (1) before December (12), as in the original.
    assert [(x.traffic_month, x.total_monthly_traffic) for x in m.collect()] == [(1, 114096), (12, 100)]
    w = summaries.weekly_totals(r, cfg)
    assert w.columns[0] == "iso_week" and [x.iso_week for x in w.collect()] == [1, 2, 53]
    g = trends.mom_growth(r, cfg).collect()
    assert [x.traffic_month for x in g] == [1, 12] and g[1].prev_month_traffic == 114096


def test_cluster_conf_sizes_partitions_from_slots():
    from hourwise.session import cluster_conf

    conf = cluster_conf(executors=1000, cores_per_executor=4)
    assert int(conf["spark.sql.shuffle.partitions"]) == 16_000
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_zero_series_gives_null_shares(spark):
    from hourwise.operators import insights

    z = spark.createDataFrame([(0, 0), (1, 0)], "hour_of_day int, traffic_count int")
    assert [r.pct_of_day_traffic for r in insights.scaling_windows(z, CFG).collect()] == [None, None]


def test_buckets_of_frames_without_file_statistics(spark):
    from hourwise.operators.windows import default_buckets

    rows = spark.createDataFrame([(i,) for i in range(100)], "x int")
    assert default_buckets(rows) == 1
    assert default_buckets(rows.join(rows, "x")) == 1
