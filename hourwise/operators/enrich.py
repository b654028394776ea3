"""Enrichment: the base readings plus the twelve derived columns, as one projection.

The original analysis adds the columns with ALTER TABLE and fills them with one UPDATE;
here they are a pure ``select`` that Catalyst folds into the scan stage, so every query
recomputes them for free instead of storing them (the enriched table can still be
written out with :func:`hourwise.sources.readings.write_enriched`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.config import TrafficConfig
from hourwise.functions.calendar import calendar_sql, traffic_category_sql
from hourwise.functions.columns import flag

BASE_COLUMNS = ("record_id", "traffic_time", "traffic_count")
ENRICHED_COLUMNS = (
    "record_id", "traffic_time", "traffic_count", "traffic_year", "traffic_month",
    "month_name", "iso_year", "traffic_week", "traffic_date", "hour_of_day", "day_of_week",
    "day_name", "is_weekend", "is_business_hr", "traffic_category", "is_spike",
)


def count_stats(readings: DataFrame) -> DataFrame:
    """One-row aggregate: mean and population std-dev of ``traffic_count``.

    A global aggregate: every task emits one partial row, so it never shuffles more
    than one row per partition whatever the data size.
    """
    return readings.agg(
        F.avg("traffic_count").alias("mean_count"),
        F.stddev_pop("traffic_count").alias("std_count"),
    )


def stats_scalar(readings: DataFrame) -> Column:
    """Mean and population std-dev of ``traffic_count`` as one scalar-subquery struct.

    Every statistic of a query (spike threshold, z-score centre and scale) is a field of
    this one subquery over the same ``traffic_count`` projection, so Spark runs a single
    one-row aggregate job for all of them.
    """
    stats = readings.selectExpr("avg(traffic_count) AS mean_count", "stddev_pop(traffic_count) AS std_count")
    return stats.selectExpr("struct(mean_count, std_count)").scalar()


def spike_threshold(readings: DataFrame, cfg: TrafficConfig) -> Column:
    """The spike threshold as a Column: a literal, or ``mean + k * stddev_pop`` taken
    from :func:`stats_scalar` (evaluated once per query and broadcast as a value)."""
    if cfg.spike_threshold is not None:
        return F.lit(cfg.spike_threshold)
    st = stats_scalar(readings)
    return st["mean_count"] + F.lit(cfg.spike_k) * st["std_count"]


def spike_threshold_frame(readings: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """The spike statistics as a one-row DataFrame (mean, std-dev, threshold)."""
    st = count_stats(readings)
    thr = (
        F.lit(float(cfg.spike_threshold))
        if cfg.spike_threshold is not None
        else F.col("mean_count") + F.lit(cfg.spike_k) * F.col("std_count")
    )
    return st.select(
        F.round("mean_count", 1).alias("mean_count"),
        F.round("std_count", 1).alias("std_count"),
        F.round(thr, 1).alias("spike_threshold"),
    )


def z_params(readings: DataFrame, cfg: TrafficConfig) -> tuple[Column, Column]:
    """Centre and scale of the spike z-score: configured literals or fields of
    :func:`stats_scalar` (the same subquery as the computed spike threshold)."""
    st = stats_scalar(readings)
    mean = F.lit(cfg.z_mean) if cfg.z_mean is not None else st["mean_count"]
    std = F.lit(cfg.z_std) if cfg.z_std is not None else st["std_count"]
    return mean, std


def enrich(readings: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Add the twelve derived columns (plus ``iso_year``) to base readings.

    ``readings`` must have ``record_id, traffic_time, traffic_count``.  Narrow: no
    shuffle; with a computed spike threshold the only extra work is one global
    aggregate evaluated as a scalar subquery (pruned when ``is_spike`` is unused).
    """
    derived = {**calendar_sql("traffic_time", cfg), "traffic_category": traffic_category_sql("traffic_count", cfg)}
    exprs = [*BASE_COLUMNS, *[f"{sql} AS {name}" for name, sql in derived.items()]]
    if cfg.spike_threshold is not None:
        fixed = f"CASE WHEN traffic_count > {cfg.spike_threshold} THEN 1 ELSE 0 END AS is_spike"
        return readings.selectExpr(*exprs, fixed)
    thr = spike_threshold(readings, cfg)
    return readings.selectExpr(*exprs).withColumn("is_spike", flag(F.col("traffic_count") > thr))
