"""Consistency properties between operators on sf0.01."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourwise.config import EVENTS, ORDERS
from hourwise.operators import summaries, trends
from hourwise.plans import reports, views
from hourwise.plans.catalog import enriched_readings


@pytest.fixture(scope="module")
def e(spark, sf001):
    return enriched_readings(spark, sf001, "E")


@pytest.fixture(scope="module")
def o(spark, sf001):
    return enriched_readings(spark, sf001, "O")


def test_cumulative_total_ends_at_total_and_100(o):
    last = trends.cumulative_total(o, ORDERS).collect()[-1]
    total = o.agg(F.sum("traffic_count")).first()[0]
    assert last.cumulative_total == total and last.pct_of_total_reached == 100.0


def test_category_counts_sum_to_rows(e):
    rows = summaries.category_distribution(e, EVENTS).collect()
    assert sum(r.record_count for r in rows) == e.count()
    assert abs(sum(r.pct_of_records for r in rows) - 100) <= 0.2


@pytest.mark.parametrize("op", [summaries.weekday_weekend, summaries.business_hours])
def test_split_shares_sum_to_100(e, op):
    assert abs(sum(r.pct_of_total_traffic for r in op(e, EVENTS).collect()) - 100) <= 0.1


def test_report_rank_equals_rank_window(e, spark):
    days = e.groupBy("traffic_date").agg(F.sum("traffic_count").alias("t"))
    ranked = {r.traffic_date: r.k for r in
              days.select("traffic_date", F.rank().over(Window.orderBy(F.desc("t"))).alias("k")).collect()}
    for d in sorted(ranked)[:5]:
        assert reports.day_summary(e, EVENTS, d).first().traffic_rank_among_all_days == ranked[d]


def test_daily_view_rolls_up_to_monthly_view(o):
    daily = views.daily_summary(o, ORDERS).groupBy(F.year("traffic_date").alias("y"),
                                                   F.month("traffic_date").alias("m")).agg(
        F.sum("hourly_readings").alias("n"), F.sum("daily_total").alias("t"), F.sum("spike_hours").alias("s"),
        F.countDistinct("traffic_date").alias("d"))
    monthly = views.monthly_kpi(o, ORDERS).select(
        F.col("traffic_year").alias("y"), F.col("traffic_month").alias("m"), F.col("hourly_readings").alias("n"),
        F.col("total_traffic").alias("t"), F.col("spike_count").alias("s"), F.col("active_days").alias("d"))
    assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, monthly.collect()))


def test_registered_views_answer_sql(spark, e):
    views.register_views(e, EVENTS)
    top = spark.sql("SELECT record_id FROM vw_spike_events ORDER BY traffic_count DESC, record_id LIMIT 15")
    direct = views.spike_events_top(e, EVENTS, 15).select("record_id")
    assert [r[0] for r in top.collect()] == [r[0] for r in direct.collect()]
    assert spark.sql("SELECT count(*) FROM vw_hourly_pattern").first()[0] == 24


def test_adhoc_sql_over_registered_readings(spark, e):
    """An original-style statement in Spark SQL against the registered enriched readings."""
    views.register_views(e, EVENTS)
    got = spark.sql("""
        SELECT hour_of_day, ROUND(AVG(traffic_count), 1) AS avg_traffic,
               ROUND(STDDEV_POP(traffic_count), 1) AS std_dev
        FROM traffic_readings GROUP BY hour_of_day ORDER BY hour_of_day""").collect()
    from hourwise.operators import insights

    want = insights.consistency_score(e, EVENTS).orderBy("hour_of_day").collect()
    assert [(r.hour_of_day, r.avg_traffic, r.std_dev) for r in got] == \
        [(r.hour_of_day, r.avg_traffic, r.std_dev) for r in want]


def test_scaling_coverage_keeps_hours_up_to_the_share(e):
    from hourwise.operators import insights

    full = insights.scaling_windows(e, EVENTS).collect()
    cut = insights.scaling_windows(e, EVENTS, coverage=80.0).collect()
    # All hours until the running share first reaches 80 %, in the same order.
    k = next(i for i, r in enumerate(full) if r.cumulative_pct >= 80.0)
    assert [r.hour_of_day for r in cut] == [r.hour_of_day for r in full[:k + 1]]
    assert full[-1].cumulative_pct == 100.0
