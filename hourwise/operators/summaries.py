"""Exploration and pattern summaries over enriched readings ``r``.

Each operator is ``(r, cfg) -> DataFrame`` built from ``groupBy().agg()``: Spark plans a
partial (map-side) hash aggregate per task and shuffles only one row per group per
task, so hot groups (a weekday, an hour, a band holding a third of the rows) never
concentrate raw rows in one task.

"Share of the total" columns divide by a total taken over the *grouped* rows (a window
over at most 7 rows, or 24 for hours) instead of re-scanning the readings for a scalar
subquery: one scan per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.config import CATEGORY_ORDER, TrafficConfig
from hourwise.functions.columns import (
    avg1, count_all, field_position, growth_pct, hour_label, label_if, pct, std1, sum_long, text_bar,
)


def grand(c: str | Column) -> Column:
    """Total of a column over all rows of a small grouped result (never raw readings)."""
    return F.sum(c).over(Window.partitionBy())


def month_keys(cfg: TrafficConfig) -> list[str]:
    return ["traffic_year", "traffic_month"] if cfg.year_safe else ["traffic_month"]


def week_keys(cfg: TrafficConfig) -> list[str]:
    return ["iso_year", "traffic_week"] if cfg.year_safe else ["traffic_week"]


# Q1 ---------------------------------------------------------------------------------------
def dataset_overview(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """One-line summary: counts, time span (calendar days), sum, mean, extremes, population std."""
    return r.agg(
        count_all().alias("total_records"),
        F.min("traffic_time").alias("data_starts"),
        F.max("traffic_time").alias("data_ends"),
        F.datediff(F.max("traffic_time"), F.min("traffic_time")).alias("span_days"),
        sum_long("traffic_count").alias("total_traffic"),
        avg1().alias("avg_hourly_traffic"),
        F.min("traffic_count").alias("min_traffic"),
        F.max("traffic_count").alias("max_traffic"),
        std1().alias("std_deviation"),
    )


# Q2 / exec section 8 ----------------------------------------------------------------------
def category_distribution(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Readings per traffic band with their share of all readings, in Peak..Low order."""
    g = r.groupBy("traffic_category").agg(
        count_all().alias("record_count"),
        sum_long("traffic_count").alias("total_traffic"),
        avg1().alias("avg_traffic"),
        F.min("traffic_count").alias("min_traffic"),
        F.max("traffic_count").alias("max_traffic"),
    )
    return g.select(
        "traffic_category", "record_count",
        pct("record_count", grand("record_count")).alias("pct_of_records"),
        "total_traffic", "avg_traffic", "min_traffic", "max_traffic",
    ).orderBy(field_position("traffic_category", CATEGORY_ORDER))


# Q3 ---------------------------------------------------------------------------------------
def top_spikes(r: DataFrame, cfg: TrafficConfig, n: int = 20) -> DataFrame:
    """The ``n`` largest spike readings (a per-task top-n merged on the driver)."""
    return (
        r.filter(F.col("is_spike") == 1)
        .orderBy(F.desc("traffic_count"), F.asc("record_id"))
        .limit(n)
        .select("traffic_time", "traffic_count", "day_name", "hour_of_day", "month_name")
    )


# Q4 ---------------------------------------------------------------------------------------
def monthly_summary(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Per-month totals with month-over-month growth of the total (LAG over months)."""
    keys = month_keys(cfg)
    g = r.groupBy(*keys, "month_name").agg(
        count_all().alias("hourly_readings"),
        sum_long("traffic_count").alias("total_monthly_traffic"),
        avg1().alias("avg_hourly_traffic"),
        F.max("traffic_count").alias("peak_hour_traffic"),
        F.min("traffic_count").alias("slowest_hour_traffic"),
    )
    # One row per month: the un-partitioned LAG window only ever sees the month rows.
    prev = F.lag("total_monthly_traffic").over(Window.orderBy(*keys))
    return g.select(
        *keys, "month_name", "hourly_readings", "total_monthly_traffic", "avg_hourly_traffic",
        "peak_hour_traffic", "slowest_hour_traffic",
        growth_pct("total_monthly_traffic", prev).alias("mom_growth_pct"),
    ).orderBy(*keys)


# Q5 ---------------------------------------------------------------------------------------
def weekly_totals(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Per ISO week: first/last date seen, readings, total, mean, peak."""
    keys = week_keys(cfg)
    g = r.groupBy(*keys).agg(
        F.min("traffic_date").alias("week_starts"),
        F.max("traffic_date").alias("week_ends"),
        count_all().alias("readings"),
        sum_long("traffic_count").alias("total_traffic"),
        avg1().alias("avg_hourly_traffic"),
        F.max("traffic_count").alias("peak_traffic"),
    )
    out = [k if k != "traffic_week" else "iso_week" for k in keys]
    g = g.withColumnRenamed("traffic_week", "iso_week")
    return g.select(*out, "week_starts", "week_ends", "readings", "total_traffic",
                    "avg_hourly_traffic", "peak_traffic").orderBy(*out)


# Q6 ---------------------------------------------------------------------------------------
def daily_totals(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Per day: readings, total, mean, peak reading."""
    return r.groupBy("traffic_date", "day_name").agg(
        count_all().alias("hourly_readings"),
        sum_long("traffic_count").alias("daily_total"),
        avg1().alias("avg_per_hour"),
        F.max("traffic_count").alias("peak_hour_count"),
    )


def daily_totals_top(r: DataFrame, cfg: TrafficConfig, n: int = 20) -> DataFrame:
    return daily_totals(r, cfg).orderBy(F.desc("daily_total"), "traffic_date").limit(n)


# Q8 ---------------------------------------------------------------------------------------
def hourly_pattern(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Shape of a typical day: per hour of day, with a text bar (one block per ``bar_unit``)."""
    g = r.groupBy("hour_of_day").agg(
        count_all().alias("days_observed"),
        F.avg("traffic_count").alias("_avg"),
        F.max("traffic_count").alias("peak_traffic"),
        F.min("traffic_count").alias("min_traffic"),
    )
    return g.select(
        "hour_of_day",
        hour_label("hour_of_day", named=True).alias("hour_label"),
        "days_observed",
        F.round("_avg", 1).alias("avg_traffic"),
        "peak_traffic", "min_traffic",
        text_bar("_avg", cfg.bar_unit).alias("traffic_bar"),
    ).orderBy("hour_of_day")


# Q9 ---------------------------------------------------------------------------------------
def dow_pattern(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Per weekday; the mean as % of the overall mean (overall = Σsum / Σcount of the groups)."""
    g = r.groupBy("day_of_week", "day_name").agg(
        count_all().alias("hourly_readings"),
        F.avg("traffic_count").alias("_avg"),
        sum_long("traffic_count").alias("total_traffic"),
        F.max("traffic_count").alias("peak_traffic"),
    )
    overall = grand("total_traffic") / grand("hourly_readings")
    return g.select(
        "day_of_week", "day_name", "hourly_readings",
        F.round("_avg", 1).alias("avg_hourly_traffic"),
        "total_traffic", "peak_traffic",
        pct("_avg", overall).alias("pct_of_overall_avg"),
    ).orderBy("day_of_week")


# Q10 / Q11 / exec section 4 -----------------------------------------------------------------
def _flag_split(r: DataFrame, flag_col: str, label: Column, label_name: str,
                with_peak: bool) -> DataFrame:
    aggs = [
        count_all().alias("hourly_readings"),
        avg1().alias("avg_hourly_traffic"),
        sum_long("traffic_count").alias("total_traffic"),
    ]
    if with_peak:
        aggs.append(F.max("traffic_count").alias("peak_traffic"))
    g = r.groupBy(flag_col).agg(*aggs)
    cols = [label.alias(label_name), "hourly_readings", "avg_hourly_traffic", "total_traffic"]
    if with_peak:
        cols.append("peak_traffic")
    cols.append(pct("total_traffic", grand("total_traffic")).alias("pct_of_total_traffic"))
    return g.select(*cols).orderBy(label_name)


def weekday_weekend(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return _flag_split(r, "is_weekend", label_if(F.col("is_weekend") == 0, "Weekday", "Weekend"),
                       "day_type", with_peak=True)


def business_hours(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    lo, hi = cfg.business_hours
    name = f"Business Hours ({_clock(lo)}-{_clock(hi)})"
    return _flag_split(r, "is_business_hr", label_if(F.col("is_business_hr") == 1, name, "Off Hours"),
                       "period", with_peak=False)


def _clock(h: int) -> str:
    """Start of hour ``h`` or the end of hour ``h`` for the upper bound, 12-hour style."""
    return f"{h}am" if h < 12 else ("12pm" if h == 12 else f"{h - 12}pm")


# Q12 --------------------------------------------------------------------------------------
HEATMAP_DAYS = (("Monday", "Mon"), ("Tuesday", "Tue"), ("Wednesday", "Wed"), ("Thursday", "Thu"),
                ("Friday", "Fri"), ("Saturday", "Sat"), ("Sunday", "Sun"))


def hour_dow_heatmap(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Hour x weekday mean, one column per weekday (Mon..Sun).

    Seven conditional means in one ``groupBy(hour)``: a single partial/final aggregate
    (a ``pivot`` would plan a second aggregation level and shuffle for the same cells).
    """
    cells = [F.expr(f"round(avg(CASE WHEN day_name = '{day}' THEN traffic_count END), 0)").alias(short)
             for day, short in HEATMAP_DAYS]
    return r.groupBy("hour_of_day").agg(*cells).orderBy("hour_of_day")
