"""Statistics of counts that merge: per part (a day, a micro-batch) n, total and M2, and their union.

``M2`` is a part's sum of squared deviations from its own mean; parts merge as M2 = sum(m2) + sum(n * (mean_i - mean)^2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.config import TrafficConfig


def part_stats(readings: DataFrame, *keys: str | Column) -> DataFrame:
    """n, total and m2 of ``traffic_count`` by ``keys`` (one row without keys, even for no readings)."""
    return readings.groupBy(*keys).agg(
        F.expr("count(1)").alias("n"), F.expr("CAST(sum(traffic_count) AS BIGINT)").alias("total"),
        F.expr("var_pop(traffic_count) * count(1)").alias("m2"))


def union_stats(parts: DataFrame) -> DataFrame:
    """One row over all parts (few rows): n, mean_count and std_count (population), null without readings."""
    some = parts.where("n > 0")
    mean = some.agg(F.expr("sum(total) / sum(n)")).scalar()
    spread = some.select("n", "total", "m2", (F.col("total") / F.col("n") - mean).alias("d"))
    return spread.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.expr("sum(total) / sum(n)").alias("mean_count"),
        F.expr("sqrt((sum(m2) + sum(n * d * d)) / sum(n))").alias("std_count"))


def threshold_of(parts: DataFrame, cfg: TrafficConfig) -> tuple[Column, Column, Column]:
    """Spike threshold, mean and std-dev as Columns: configured numbers, or fields of one scalar subquery over ``parts``."""
    st = union_stats(parts).selectExpr("struct(mean_count, std_count)").scalar()
    mean = F.lit(cfg.z_mean) if cfg.z_mean is not None else st["mean_count"]
    std = F.lit(cfg.z_std) if cfg.z_std is not None else st["std_count"]
    if cfg.spike_threshold is not None:
        return F.lit(cfg.spike_threshold), mean, std
    return st["mean_count"] + F.lit(cfg.spike_k) * st["std_count"], mean, std
