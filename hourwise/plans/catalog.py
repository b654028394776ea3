"""Registry of every query of the analysis, bound to the test-data fixtures.

Fixture **E** = readings of ``events`` (sub-hour timestamps: hour, weekday, band, spike
and row-window queries); fixture **O** = readings of ``orders`` (one timestamp per day
over six years: month, week and day-trend queries).  Each entry reads the whole table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise import config
from hourwise.config import TrafficConfig
from hourwise.operators import insights, summaries, trends, windows
from hourwise.operators.enrich import ENRICHED_COLUMNS, enrich, spike_threshold_frame
from hourwise.plans import moments, reports, views
from hourwise.sources import readings as src
from hourwise.sources.stored import EnrichedTable

# Report parameters (dates inside each fixture's span).
DAILY_REPORT_DAY = dt.date(2024, 1, 15)  # E
RANGE_E = (dt.date(2024, 1, 8), dt.date(2024, 1, 14))  # E: one ISO week
RANGE_O = (dt.date(1996, 2, 1), dt.date(1996, 2, 29))  # O: a leap-year February

FIXTURES: dict[str, tuple[Callable[..., DataFrame], TrafficConfig]] = {
    "E": (src.from_events, config.EVENTS),
    "O": (src.from_orders, config.ORDERS),
    # parity mode: the original's fixed constants, keys without years
    "EP": (src.from_events, config.REFERENCE),
    "OP": (src.from_orders, config.REFERENCE),
}


def base_readings(spark: SparkSession, sf_dir: str, fixture: str, strict: bool = False) -> DataFrame:
    return FIXTURES[fixture][0](spark, sf_dir, strict=strict)


def enriched_readings(spark: SparkSession, sf_dir: str, fixture: str) -> DataFrame:
    reader, cfg = FIXTURES[fixture]
    return enrich(reader(spark, sf_dir), cfg)


@dataclass(frozen=True)
class QuerySpec:
    key: str
    fixture: str
    op: Callable[[DataFrame, TrafficConfig], DataFrame]
    on: str = "enriched"  # or "base" (operators over the three base columns)

    def build(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        reader, cfg = FIXTURES[self.fixture]
        base = reader(spark, sf_dir, strict=(self.key == "readings"))
        data = base if self.on == "base" else enrich(base, cfg)
        return self.op(data, cfg)


def _q16(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    top = windows.ntile_top(r.select("record_id", "traffic_time", "traffic_count"), 4,
                            "traffic_count", "record_id", 30, out="traffic_quartile")
    return top.orderBy(F.desc("traffic_count"), F.desc("record_id"))


def _x1(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return windows.global_ntile(r.select("record_id", "traffic_time", "traffic_count"), 4,
                                ["traffic_count", "record_id"], out="traffic_quartile")


def _moving_cols(df: DataFrame) -> DataFrame:
    avg = F.round("_moving", 1)
    return df.select("traffic_time", "traffic_count", avg.alias("moving_3hr_avg"),
                     (F.col("traffic_count") - avg).alias("deviation_from_avg"))


def _q17(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    head = windows.moving_head(r.select("record_id", "traffic_time", "traffic_count"),
                               ["traffic_time", "record_id"], "traffic_count", 1, 1, 50, out="_moving")
    return _moving_cols(head).orderBy("traffic_time")


def _x2(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    mv = windows.moving_window(r.select("record_id", "traffic_time", "traffic_count"),
                               ["traffic_time", "record_id"], "traffic_count", 1, 1, out="_moving")
    return _moving_cols(mv)


def _new_folder(spark: SparkSession, what: str) -> str:
    import uuid

    from hourwise.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/hourwise-{what}-{uuid.uuid4().hex}"


def _load_csv(b: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """CSV source round trip: export the readings, in the order of their ids, in the original CSV layout to the shared
    checkpoint folder, then import them (typed schema, ``n.0`` counts, keys by import order)."""
    path = _new_folder(b.sparkSession, "csv")
    src.write_csv(b.orderBy("record_id"), path)
    return src.read_csv(b.sparkSession, path)


def _stored(b: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """The stored enriched table: written, one day replaced by corrected readings (counts doubled), read back."""
    table = EnrichedTable(b.sparkSession, _new_folder(b.sparkSession, "enriched"), cfg)
    table.replace_days(b)
    day = b.where(F.to_date("traffic_time") == F.lit(DAILY_REPORT_DAY))
    table.replace_days(day.withColumn("traffic_count", F.col("traffic_count") * 2))
    return table.read()


def _report_sink(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """A range report written by its sink; its daily section read back."""
    path = _new_folder(r.sparkSession, "report")
    reports.range_report(r, cfg, *RANGE_O).write(path)
    return r.sparkSession.read.parquet(f"{path}/daily")


def _one_scan(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """The measures behind the seven aggregate sections of the executive report, from one scan."""
    m = moments.executive_moments(r, cfg)
    keys = [c for c in m.columns if c not in moments.MEASURES and c != "set_id"]
    month = F.when(F.col("set_id") == moments.EXEC_SETS.index(insights.MONTH_SET), F.col("month_days")).alias("month_days")
    return m.select("set_id", *keys, "n", "total", F.round("mean", 1).alias("mean"), "lo", "hi", F.round("std", 1).alias("std"),
                    "spikes", month, "first_time", "last_time")


def _findings(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    sets = insights.FINDING_SETS
    return insights.findings(moments.all_sets(moments.build_cells(r, cfg), sets), sets)


def _read_view(name: str, rest: str):
    """SQL over a registered view, as its users read it."""

    def op(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
        views.register_views(r, cfg, readings_view=None, names=[name])
        return r.sparkSession.sql(f"SELECT * FROM {name} {rest}")

    return op


def _exec(section: int):
    """Section (from 1) of the executive report."""
    return lambda r, c: reports.executive_report(r, c)[reports.EXEC_TITLES[section - 1]]


def _enriched_preview(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """First 8 enriched readings: the enrichment is a projection in the scan stage and
    ``orderBy().limit()`` plans a per-task top-8 (TakeOrderedAndProject).  (Enriching only
    the 8 rows after the limit lets Catalyst push the projection under the limit, which
    turns the top-k into a global sort - far worse at scale.)"""
    return r.orderBy("traffic_time", "record_id").limit(8).select(
        "traffic_time", "traffic_count", "month_name", "day_name",
        "is_weekend", "is_business_hr", "traffic_category", "is_spike")


def _specs() -> list[QuerySpec]:
    d = DAILY_REPORT_DAY
    return [
        # Sources, load checks, enrichment
        QuerySpec("load_csv", "E", _load_csv, on="base"),
        QuerySpec("readings", "E", lambda b, c: b.select(*src.READINGS_SCHEMA.names), on="base"),
        QuerySpec("load_count", "E", lambda b, c: src.count_readings(b, c.expected_rows), on="base"),
        QuerySpec("preview_first10", "E", lambda b, c: src.preview(b, 10), on="base"),
        QuerySpec("enriched", "E", lambda r, c: r.select(*ENRICHED_COLUMNS)),
        QuerySpec("enriched_preview", "E", _enriched_preview),
        QuerySpec("spike_threshold", "E", spike_threshold_frame, on="base"),
        # Exploration and trends
        QuerySpec("dataset_overview", "E", summaries.dataset_overview),
        QuerySpec("category_distribution", "E", summaries.category_distribution),
        QuerySpec("top_spikes", "E", summaries.top_spikes),
        QuerySpec("monthly_summary", "O", summaries.monthly_summary),
        QuerySpec("weekly_totals", "O", summaries.weekly_totals),
        QuerySpec("daily_totals_top20", "E", summaries.daily_totals_top),
        QuerySpec("rolling_7day_avg", "O", trends.rolling_7day_avg),
        # Hour / weekday patterns
        QuerySpec("hourly_pattern", "E", summaries.hourly_pattern),
        QuerySpec("dow_pattern", "E", summaries.dow_pattern),
        QuerySpec("weekday_weekend", "E", summaries.weekday_weekend),
        QuerySpec("business_hours", "E", summaries.business_hours),
        QuerySpec("hour_dow_heatmap", "E", summaries.hour_dow_heatmap),
        # Window analytics
        QuerySpec("rank_in_month", "O", trends.rank_in_month),
        QuerySpec("cumulative_total", "O", trends.cumulative_total),
        QuerySpec("day_over_day", "O", trends.day_over_day),
        QuerySpec("ntile_quartiles", "E", _q16),
        QuerySpec("moving_3row_avg", "E", _q17),
        QuerySpec("ntile_quartiles_scaled", "E", _x1),
        QuerySpec("moving_3row_avg_scaled", "E", _x2),
        # Views and their readers
        QuerySpec("vw_daily_summary", "E", views.daily_summary),
        QuerySpec("vw_daily_summary_top10", "E", _read_view("vw_daily_summary", "ORDER BY daily_total DESC, traffic_date LIMIT 10")),
        QuerySpec("vw_hourly_pattern", "E", _read_view("vw_hourly_pattern", "ORDER BY hour_of_day, is_business_hr")),
        QuerySpec("vw_monthly_kpi", "O", _read_view("vw_monthly_kpi", "ORDER BY traffic_year, traffic_month")),
        QuerySpec("vw_spike_events", "E", views.spike_events),
        QuerySpec("vw_spike_events_top15", "E", _read_view("vw_spike_events", "ORDER BY traffic_count DESC, record_id LIMIT 15")),
        # Reports
        QuerySpec("daily_report_summary", "E", lambda r, c: reports.daily_report(r, c, d)["summary"]),
        QuerySpec("daily_report_hours", "E", lambda r, c: reports.daily_report(r, c, d)["hours"]),
        QuerySpec("range_report_summary", "O", lambda r, c: reports.range_report(r, c, *RANGE_O)["summary"]),
        QuerySpec("range_report_daily", "O", lambda r, c: reports.range_report(r, c, *RANGE_O)["daily"]),
        QuerySpec("range_report_hours", "E", lambda r, c: reports.range_report(r, c, *RANGE_E)["hours"]),
        QuerySpec("exec_overview", "E", _exec(1)),
        QuerySpec("exec_monthly", "O", _exec(2)),
        QuerySpec("exec_hourly", "E", _exec(3)),
        QuerySpec("exec_weekday_weekend", "E", _exec(4)),
        QuerySpec("exec_top_days", "E", _exec(5)),
        QuerySpec("exec_low_days", "E", _exec(6)),
        QuerySpec("exec_spikes", "E", _exec(7)),
        QuerySpec("exec_categories", "E", _exec(8)),
        QuerySpec("exec_one_scan", "E", _one_scan),
        QuerySpec("report_sink", "O", _report_sink),
        QuerySpec("stored_enriched", "E", _stored, on="base"),
        # Insights
        QuerySpec("findings_events", "E", _findings),
        QuerySpec("findings_orders", "O", _findings),
        QuerySpec("insight_scaling", "E", insights.scaling_windows),
        QuerySpec("insight_maintenance", "E", insights.maintenance_window),
        QuerySpec("insight_alerts", "E", insights.anomaly_calendar),
        QuerySpec("insight_weekend", "E", insights.weekend_profile),
        QuerySpec("insight_mom_growth", "O", trends.mom_growth),
        QuerySpec("insight_consistency", "E", insights.consistency_score),
        # Parity mode: fixed constants, months and weeks without their years
        QuerySpec("parity_monthly_summary", "OP", summaries.monthly_summary),
        QuerySpec("parity_weekly_totals", "OP", summaries.weekly_totals),
        QuerySpec("parity_rank_in_month", "OP", trends.rank_in_month),
        QuerySpec("parity_cumulative_total", "OP", trends.cumulative_total),
        QuerySpec("parity_mom_growth", "OP", trends.mom_growth),
        QuerySpec("parity_spike_events", "EP", views.spike_events),
        QuerySpec("parity_weekday_weekend", "EP", moments.SECTIONS["exec_weekday_weekend"].direct),
    ]


SPECS: dict[str, QuerySpec] = {s.key: s for s in _specs()}
FLAGSHIP = "vw_daily_summary"


def query_functions() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: s.build for k, s in SPECS.items()}
