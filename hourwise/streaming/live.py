"""The daily summary and spike feed over a *stream* of readings (Structured Streaming).

The original analysis is batch only; this module runs the same enrichment and day-level
aggregate incrementally as new reading files arrive, so the summary view can be kept
current.  Differences forced by streaming:

* the spike threshold must be known up front (``cfg.spike_threshold``, e.g. taken from a
  batch run of :func:`hourwise.operators.enrich.spike_threshold_frame`): a global mean and
  std-dev over an unbounded stream is not a fixed value;
* days are event-time windows with a watermark (latest reading time minus ``lateness``):
  in append mode a day's row is emitted once the watermark passes the end of the day, and
  readings for such a closed day that arrive in a later micro-batch are dropped (Spark
  filters late rows with the previous batch's watermark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.config import TrafficConfig
from hourwise.functions.columns import count_all, sum_long
from hourwise.operators.enrich import enrich
from hourwise.sources.readings import READINGS_SCHEMA


def readings_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of base readings (``record_id, traffic_time, traffic_count``) in ``path``."""
    reader = spark.readStream.schema(READINGS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _require_threshold(cfg: TrafficConfig) -> None:
    if cfg.spike_threshold is None:
        raise ValueError("streaming needs a fixed cfg.spike_threshold")


def daily_summary_stream(readings: DataFrame, cfg: TrafficConfig, lateness: str = "1 day") -> DataFrame:
    """Streaming form of the daily-summary view, one row per (day, weekday, ...) group.

    Grouping on the 1-day event-time window lets the watermark close days; the window's
    days are those of the wall clock in any session time zone.  Watermarks need a TIMESTAMP
    column and windows are cut at UTC midnight, so the event time is the wall-clock time
    taken as UTC.
    """
    _require_threshold(cfg)
    r = (enrich(readings, cfg).withColumn("_event_time", F.from_utc_timestamp(
        F.col("traffic_time").cast("timestamp"), F.current_timezone()))
         .withWatermark("_event_time", lateness))
    g = r.groupBy(F.window("_event_time", "1 day").alias("day"), "traffic_date", "day_name", "month_name", "traffic_week",
                  "is_weekend").agg(
        count_all().alias("hourly_readings"),
        sum_long("traffic_count").alias("daily_total"),
        F.round(F.avg("traffic_count"), 1).alias("avg_per_hour"),
        F.max("traffic_count").alias("peak_hour"),
        F.min("traffic_count").alias("slowest_hour"),
        sum_long("is_spike").alias("spike_hours"),
    )
    return g.select("traffic_date", "day_name", "month_name", "traffic_week",
                    "is_weekend", "hourly_readings", "daily_total", "avg_per_hour", "peak_hour", "slowest_hour",
                    "spike_hours")


def spike_stream(readings: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Spike readings as they arrive (stateless filter), with the z-score of the spike view."""
    _require_threshold(cfg)
    if cfg.z_mean is None or cfg.z_std is None:
        raise ValueError("streaming needs fixed cfg.z_mean and cfg.z_std")
    r = enrich(readings, cfg)
    return r.filter(F.col("is_spike") == 1).select(
        "record_id", "traffic_time", "traffic_date", "day_name", "hour_of_day", "month_name", "traffic_count",
        F.round(F.try_divide(F.col("traffic_count") - F.lit(cfg.z_mean), F.lit(cfg.z_std)), 2).alias("z_score"),
    )
