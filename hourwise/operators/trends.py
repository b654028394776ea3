"""Time trends: windows over *daily* or *monthly* aggregates.

The readings are first reduced to one row per day (partial + final hash aggregate), and
only then windowed.  The un-partitioned windows below therefore see one row per day /
month (a few thousand rows even for decades of data), never raw readings.  Frames are
row based like the original: "7-day" = the current and 6 previous *existing* days, the
previous day of LAG = the previous existing day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwise.config import TrafficConfig
from hourwise.functions.columns import growth_pct, pct, sum_long
from hourwise.operators.summaries import month_keys


def by_day() -> Window:
    return Window.orderBy("traffic_date")


def daily_sums(r: DataFrame, *keys: str) -> DataFrame:
    """``SUM(traffic_count) AS daily_total`` per day (plus extra day-level keys)."""
    return r.groupBy("traffic_date", *keys).agg(sum_long("traffic_count").alias("daily_total"))


# Q7 ---------------------------------------------------------------------------------------
def rolling_7day_avg(r: DataFrame, cfg: TrafficConfig, days: int = 7) -> DataFrame:
    d = daily_sums(r, "day_name")
    w = by_day().rowsBetween(-(days - 1), Window.currentRow)
    return d.select(
        "traffic_date", "day_name", "daily_total",
        F.round(F.avg("daily_total").over(w), 1).alias(f"rolling_{days}day_avg"),
    ).orderBy("traffic_date")


# Q13 --------------------------------------------------------------------------------------
def rank_in_month(r: DataFrame, cfg: TrafficConfig, n: int | None = 30) -> DataFrame:
    """Days ranked by total within their month (a window partitioned by month)."""
    mk = month_keys(cfg)
    d = daily_sums(r, "month_name", "day_name", *mk)
    w = Window.partitionBy(*mk).orderBy(F.desc("daily_total"))
    ranked = d.select(
        "traffic_date", "month_name", "day_name", "daily_total",
        F.rank().over(w).alias("rank_in_month"), *mk,
    ).orderBy(*mk, "rank_in_month", "traffic_date")
    if n is not None:
        ranked = ranked.limit(n)
    return ranked.select("traffic_date", "month_name", "day_name", "daily_total", "rank_in_month")


# Q14 --------------------------------------------------------------------------------------
def cumulative_total(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Running total by day and the share of the grand total reached so far.

    The grand total is ``cfg.grand_total`` when configured (parity) or the real total,
    taken from the same one-row-per-day window (no second scan).
    """
    d = daily_sums(r)
    running = F.sum("daily_total").over(by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = (F.lit(cfg.grand_total) if cfg.grand_total is not None
             else F.sum("daily_total").over(Window.partitionBy()))
    return d.select(
        "traffic_date", "daily_total", running.alias("cumulative_total"),
        pct(running, total, 2).alias("pct_of_total_reached"),
    ).orderBy("traffic_date")


# Q15 --------------------------------------------------------------------------------------
def day_over_day(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    d = daily_sums(r, "day_name")
    prev = F.lag("daily_total", 1).over(by_day())
    return d.select(
        "traffic_date", "day_name", "daily_total",
        prev.alias("prev_day_total"),
        (F.col("daily_total") - prev).alias("day_over_day_change"),
        growth_pct("daily_total", prev).alias("pct_change"),
    ).orderBy("traffic_date")


# Insight 5 --------------------------------------------------------------------------------
def mom_growth(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Monthly totals, average per active day, and growth over the previous month."""
    mk = month_keys(cfg)
    # the days of one month of one year are a bit mask: a single exchange, where a distinct count needs two
    m = r.groupBy("traffic_year", "traffic_month", "month_name").agg(
        sum_long("traffic_count").alias("total_traffic"),
        F.expr("CAST(bit_count(bit_or(shiftleft(1, day(traffic_date) - 1))) AS BIGINT)").alias("active_days"),
    )
    if "traffic_year" not in mk:  # a row for each month of each year is left
        m = m.groupBy(*mk, "month_name").agg(sum_long("total_traffic").alias("total_traffic"), sum_long("active_days").alias("active_days"))
    prev = F.lag("total_traffic").over(Window.orderBy(*mk))
    return m.select(
        *mk, "month_name", "total_traffic",
        F.round(F.col("total_traffic") / F.col("active_days"), 1).alias("avg_daily"),
        prev.alias("prev_month_traffic"),
        growth_pct("total_traffic", prev).alias("growth_pct"),
    ).orderBy(*mk)
