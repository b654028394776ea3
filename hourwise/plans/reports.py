"""Parameterised multi-section reports (the original's stored procedures).

A report is an ordered mapping ``section -> lazy DataFrame`` (a section's plan is built when it is
asked for) plus the audit entries to append once its sections have been produced.  Nothing is
collected: the caller writes or displays each section (:meth:`Report.write` writes every section to
Parquet and then appends the log entries - one job per section, one append for the log).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.config import TrafficConfig
from hourwise.functions.columns import avg1, count_all, sum_long
from hourwise.plans import moments, views
from hourwise.sources.audit import AuditLog


class Sections(Mapping):
    """Section name -> DataFrame, each built when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass
class Report:
    """``run_id`` names one run of the report: however often it is written again, its audit rows stand once."""

    sections: Mapping[str, DataFrame]
    log_entries: list[tuple[str, str]] = field(default_factory=list)
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    #: Sections to write where they differ from those to read one by one (the executive report: all from one scan).
    to_write: Callable[[], Mapping[str, DataFrame]] | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.sections[name]

    def write(self, base_path: str, audit: AuditLog | None = None, mode: str = "overwrite") -> None:
        sections = self.to_write() if self.to_write else self.sections
        for name, df in sections.items():
            df.write.mode(mode).parquet(f"{base_path.rstrip('/')}/{name}")
        if audit is not None and self.log_entries:
            audit.append(self.log_entries, run_id=self.run_id)


def _date(d: dt.date | str) -> Column:
    return F.lit(d if isinstance(d, dt.date) else dt.date.fromisoformat(d))


# Procedure 1 ------------------------------------------------------------------------------
def day_summary(r: DataFrame, cfg: TrafficConfig, day: dt.date | str) -> DataFrame:
    """One row for ``day`` with the rank of its total among all days.

    The readings are read once: every day becomes one row with all measures, the days are
    ranked (thousands of rows, even for decades), and the day is picked.  For a date without
    readings the row has count 0, NULL measures and rank 1.
    """
    days = r.groupBy("traffic_date").agg(
        F.max("day_name").alias("day_of_week"),
        F.max("month_name").alias("month"),
        count_all().alias("total_readings"),
        sum_long("traffic_count").alias("total_traffic"),
        avg1().alias("avg_per_hour"),
        F.max("traffic_count").alias("peak_traffic"),
        F.min("traffic_count").alias("min_traffic"),
        sum_long("is_spike").alias("spike_hours"),
    )
    place = F.rank().over(Window.orderBy(F.desc("total_traffic"))).cast("bigint")
    ranked = days.withColumn("traffic_rank_among_all_days", place)
    absent = {"total_readings": 0, "traffic_rank_among_all_days": 1}
    measures = [F.max(c).alias(c) for c in ranked.columns if c != "traffic_date"]
    return ranked.filter(F.col("traffic_date") == _date(day)).agg(*measures).select(
        _date(day).alias("report_date"),
        *(F.coalesce(F.col(c), F.lit(absent[c]).cast("bigint")).alias(c) if c in absent else c
          for c in ranked.columns if c != "traffic_date"),
    )


SPIKE_MARK = "⚠ SPIKE"


def day_hours(r: DataFrame, cfg: TrafficConfig, day: dt.date | str) -> DataFrame:
    """Every reading of ``day`` in time order, with its band and a spike marker."""
    on_day = r.filter(F.col("traffic_date") == _date(day))
    return on_day.orderBy("hour_of_day", "traffic_time", "record_id").select(
        "hour_of_day", "traffic_count", "traffic_category",
        F.when(F.col("is_spike") == 1, F.lit(SPIKE_MARK)).otherwise(F.lit("")).alias("spike_flag"),
    )


# Audit entries written by the reports, fixed values ({} = the report date):
DAILY_LOG_NAME = "sp_daily_report({})"
DAILY_LOG_FINDING = "Report generated for {}"
EXEC_LOG_ENTRY = ("sp_executive_report", "Full report generated")


def daily_report(r: DataFrame, cfg: TrafficConfig, day: dt.date | str) -> Report:
    d = day if isinstance(day, dt.date) else dt.date.fromisoformat(day)
    return Report(
        Sections({"summary": lambda: day_summary(r, cfg, d), "hours": lambda: day_hours(r, cfg, d)}),
        [(DAILY_LOG_NAME.format(d.isoformat()), DAILY_LOG_FINDING.format(d.isoformat()))],
    )


# Procedure 2 ------------------------------------------------------------------------------
def _in_range(r: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    return r.filter(F.col("traffic_date").between(_date(start), _date(end)))


def range_summary(r: DataFrame, cfg: TrafficConfig, start: dt.date | str, end: dt.date | str) -> DataFrame:
    s, e = _date(start), _date(end)
    return _in_range(r, start, end).agg(
        s.alias("from_date"),
        e.alias("to_date"),
        (F.datediff(e, s) + 1).alias("days_in_range"),
        count_all().alias("hourly_readings"),
        sum_long("traffic_count").alias("total_traffic"),
        avg1().alias("avg_hourly_traffic"),
        F.max("traffic_count").alias("peak_traffic"),
        sum_long("is_spike").alias("spike_count"),
    )


def range_daily(r: DataFrame, cfg: TrafficConfig, start: dt.date | str, end: dt.date | str) -> DataFrame:
    return _in_range(r, start, end).groupBy("traffic_date", "day_name").agg(
        sum_long("traffic_count").alias("daily_total"),
        avg1().alias("avg_per_hour"),
        F.max("traffic_count").alias("peak_hour"),
        sum_long("is_spike").alias("spikes"),
    ).orderBy("traffic_date")


def range_hours(r: DataFrame, cfg: TrafficConfig, start: dt.date | str, end: dt.date | str) -> DataFrame:
    return _in_range(r, start, end).groupBy("hour_of_day").agg(
        avg1().alias("avg_traffic_this_range")).orderBy("hour_of_day")


def range_report(r: DataFrame, cfg: TrafficConfig, start: dt.date | str, end: dt.date | str) -> Report:
    """Summary, daily breakdown and hour pattern of a date range (inclusive).  Like the
    original this report writes no audit entry."""
    return Report(Sections({
        "summary": lambda: range_summary(r, cfg, start, end),
        "daily": lambda: range_daily(r, cfg, start, end),
        "hours": lambda: range_hours(r, cfg, start, end),
    }))


# Procedure 3 ------------------------------------------------------------------------------
# Section titles of the executive report, fixed values:
EXEC_TITLES = (
    "=== 1. DATASET OVERVIEW ===",
    "=== 2. MONTHLY PERFORMANCE ===",
    "=== 3. HOURLY PATTERN ===",
    "=== 4. WEEKDAY vs WEEKEND ===",
    "=== 5. TOP 10 PEAK DAYS ===",
    "=== 6. TOP 10 LOWEST TRAFFIC DAYS ===",
    "=== 7. TRAFFIC SPIKES (top 10) ===",
    "=== 8. TRAFFIC CATEGORY DISTRIBUTION ===",
)


def executive_report(r: DataFrame, cfg: TrafficConfig) -> Report:
    """All KPIs in eight titled sections.

    A section that is read on its own is one aggregate over ``r``.  :meth:`Report.write` answers the seven aggregate
    sections from one scan (:func:`hourwise.plans.moments.executive_moments`); only the spike list reads the readings again."""

    def sections(of: Callable[[str], DataFrame]) -> Sections:
        spikes = lambda: views.spike_events_top(r, cfg, 10)
        return Sections({t: (lambda n=n: of(n)) if n else spikes for t, n in zip(EXEC_TITLES, moments.EXECUTIVE)})

    def one_scan() -> Sections:
        rows = moments.materialize(moments.executive_moments(r, cfg))
        return sections(lambda n: moments.section_of(rows, n, cfg))

    return Report(sections(lambda n: moments.SECTIONS[n].direct(r, cfg)), [EXEC_LOG_ENTRY], to_write=one_scan)
