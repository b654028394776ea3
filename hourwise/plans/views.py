"""The four named views: lazy DataFrames, registered as temporary views on request.

A view is re-planned on every read, like the original's virtual tables; Catalyst inlines
it into the reader's plan, so a ``LIMIT`` on top becomes a per-task top-k.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.config import TrafficConfig
from hourwise.operators.enrich import z_params
from hourwise.plans import moments


def daily_summary(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """vw_daily_summary: one row per day.  ``peak_hour`` / ``slowest_hour`` are the
    largest / smallest reading of the day (counts, not hours), as in the original."""
    return moments.SECTIONS["vw_daily_summary"].direct(r, cfg)


def hourly_pattern_view(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """vw_hourly_pattern: per hour (and its business-hour flag) with population std-dev."""
    return moments.hourly_rows(moments.grouped(r, "hour_of_day", "is_business_hr"), cfg)


def monthly_kpi(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """vw_monthly_kpi: per month, including spike readings and distinct active days."""
    return moments.monthly_rows(moments.grouped(r, "traffic_year", "traffic_month", "month_name"), cfg)


def spike_events(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """vw_spike_events: spike readings with a z-score (configured or computed mean/std)."""
    mean, std = z_params(r.select("traffic_count"), cfg)
    return r.filter(F.col("is_spike") == 1).select(
        "record_id", "traffic_time", "traffic_date", "day_name", "hour_of_day", "month_name", "traffic_count",
        F.round(F.try_divide(F.col("traffic_count") - mean, std), 2).alias("z_score"),
    )


# Readers (the original relies on a view's ORDER BY; here every reader re-sorts). ------------
def daily_summary_top(r: DataFrame, cfg: TrafficConfig, n: int = 10) -> DataFrame:
    return daily_summary(r, cfg).orderBy(F.desc("daily_total"), "traffic_date").limit(n)


def hourly_pattern_sorted(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return moments.SECTIONS["vw_hourly_pattern"].direct(r, cfg)


def monthly_kpi_sorted(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return moments.SECTIONS["vw_monthly_kpi"].direct(r, cfg)


def spike_events_top(r: DataFrame, cfg: TrafficConfig, n: int = 15) -> DataFrame:
    return spike_events(r, cfg).orderBy(F.desc("traffic_count"), "record_id").limit(n)


VIEWS = {
    "vw_daily_summary": daily_summary,
    "vw_hourly_pattern": hourly_pattern_view,
    "vw_monthly_kpi": monthly_kpi,
    "vw_spike_events": spike_events,
}


def register_views(r: DataFrame, cfg: TrafficConfig, readings_view: str | None = "traffic_readings",
                   names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Create or replace the four temporary views, or only those named (and, under ``readings_view``, the
    enriched readings themselves, so ad-hoc SQL can run against them); returns them."""
    views = {n: VIEWS[n](r, cfg) for n in (VIEWS if names is None else names)}
    if readings_view:
        views[readings_view] = r
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views
