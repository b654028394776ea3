"""Mergeable moments: one set of measures for the aggregate sections, from readings or from cells.

Counts, sums, means, extremes, population std-dev, spike counts and distinct days of a month are functions of partial
aggregates that merge.  A section names its keys and projects these measures; the rows behind it come from

* :func:`grouped` - the readings, grouped by the section's keys (unused measures are pruned by Catalyst);
* :func:`merged` - cells, i.e. readings already reduced to (day, hour, band) by :func:`build_cells`;
* :func:`all_sets` - GROUPING SETS over the cells: the rows of several sections from one scan of the readings, in one plan
  (scan -> cells -> sets).  The raw rows are grouped once; only cells, days x 24 x 4 at most, are expanded by set.

Distinct days travel as a bit mask of the days of a month, so counting them needs no second aggregate.  Means are sum / n.
Deviations merge as ``M2 = sum(m2) + sum(n * d^2) - sum(n * d)^2 / N`` with d = cell mean - mean of all cells: stable, and
without the overflow of ``n * sum(x^2)`` at 10^13 rows.
"""

from __future__ import annotations

import statistics
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourwise.config import CATEGORY_ORDER, TrafficConfig
from hourwise.functions.calendar import calendar_sql
from hourwise.functions.columns import field_position, hour_label, label_if, pct, ratio
from hourwise.operators.insights import stability
from hourwise.operators.summaries import grand, month_keys
from hourwise.session import checkpoint_dir

CELL_KEYS = ("traffic_date", "hour_of_day", "traffic_category")
#: Distinct days of one month as a bit mask; meaningful where year and month are keys.
DAY_MASK = "bit_or(shiftleft(1, day(traffic_date) - 1))"
MEASURES = {
    "n": "count(1)", "total": "CAST(sum(traffic_count) AS BIGINT)", "mean": "avg(traffic_count)", "lo": "min(traffic_count)",
    "hi": "max(traffic_count)", "std": "stddev_pop(traffic_count)", "spikes": "CAST(sum(is_spike) AS BIGINT)",
    "month_days": f"CAST(bit_count({DAY_MASK}) AS BIGINT)", "first_time": "min(traffic_time)", "last_time": "max(traffic_time)",
}


def grouped(r: DataFrame, *keys: str) -> DataFrame:
    """Every measure of the readings by ``keys``."""
    return r.groupBy(*keys).agg(*[F.expr(e).alias(m) for m, e in MEASURES.items()])


def build_cells(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Partial aggregates by (day, hour, band), with the calendar columns of the cell."""
    sums = {m: MEASURES[m] for m in ("n", "total", "lo", "hi", "spikes", "first_time", "last_time")}
    cells = r.groupBy(*CELL_KEYS).agg(*[F.expr(e).alias(m) for m, e in sums.items()],
                                      F.expr("var_pop(traffic_count) * count(1)").alias("m2"))
    return with_calendar(cells, cfg)


def with_calendar(cells: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Calendar columns are functions of (date, hour): computed on cells, not readings."""
    stamp = "make_timestamp_ntz(year(traffic_date), month(traffic_date), day(traffic_date), hour_of_day, 0, 0)"
    cal = calendar_sql(f"({stamp})", cfg)
    return cells.selectExpr("*", *[f"{sql} AS {k}" for k, sql in cal.items()
                                   if k not in ("traffic_date", "hour_of_day")])


def materialize(cells: DataFrame) -> DataFrame:
    """Write a small table once to the shared checkpoint folder and read it back."""
    spark = cells.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/hourwise-cells-{uuid.uuid4().hex}"
    cells.write.parquet(path)
    return spark.read.parquet(path)


def _centred(cells: DataFrame) -> DataFrame:
    """``d``: a cell's mean less the mean of all readings (a window over the cells, days x 24 x 4 at most)."""
    every = Window.partitionBy()
    return cells.withColumn("d", F.col("total") / F.col("n") - F.sum("total").over(every) / F.sum("n").over(every))


def _merge() -> list[Column]:
    spread = "sum(m2) + sum(n * d * d) - sum(n * d) * sum(n * d) / sum(n)"
    sums = {
        "n": "CAST(sum(n) AS BIGINT)", "total": "CAST(sum(total) AS BIGINT)", "mean": "sum(total) / sum(n)", "lo": "min(lo)",
        "hi": "max(hi)", "std": f"sqrt(greatest({spread}, 0D) / sum(n))", "spikes": "CAST(sum(spikes) AS BIGINT)",
        "month_days": MEASURES["month_days"], "first_time": "min(first_time)", "last_time": "max(last_time)",
    }
    return [F.expr(e).alias(m) for m, e in sums.items()]


def merged(cells: DataFrame, *keys: str) -> DataFrame:
    """The rows of :func:`grouped`, from cells."""
    return _centred(cells).groupBy(*keys).agg(*_merge())


def all_sets(cells: DataFrame, sets: Sequence[tuple[str, ...]]) -> DataFrame:
    """The rows of several key sets in one aggregate: all keys (null where not in the set), measures, ``set_id``."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    rows = _centred(cells).groupingSets([list(s) for s in sets], *keys).agg(F.grouping_id().cast("long").alias("gid"), *_merge())
    gid = {sum((k not in s) << (len(keys) - 1 - i) for i, k in enumerate(keys)): n for n, s in enumerate(sets)}
    number = F.element_at(F.create_map(*[F.lit(x).cast("long") for g, n in gid.items() for x in (g, n)]), F.col("gid"))
    return rows.withColumn("set_id", number.cast("int")).drop("gid")


# Sections: keys, and a projection of the measures ------------------------------------------
@dataclass(frozen=True)
class Section:
    keys: tuple[str, ...]
    project: Callable[[DataFrame, TrafficConfig], DataFrame]

    def direct(self, r: DataFrame, cfg: TrafficConfig) -> DataFrame:
        return self.project(grouped(r, *self.keys), cfg)

    def from_cells(self, cells: DataFrame, cfg: TrafficConfig) -> DataFrame:
        return self.project(merged(cells, *self.keys), cfg)


def _r1(c: str) -> Column:
    return F.expr(f"round({c}, 1)")


def _overview(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return m.select(
        F.col("n").alias("total_records"), F.col("first_time").alias("data_starts"), F.col("last_time").alias("data_ends"),
        F.datediff("last_time", "first_time").alias("span_days"), F.col("total").alias("total_traffic"),
        _r1("mean").alias("avg_hourly_traffic"), F.col("lo").alias("min_traffic"), F.col("hi").alias("max_traffic"),
        _r1("std").alias("std_deviation"))


def _overview_short(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return m.select(F.col("n").alias("records"), F.col("total").alias("total_traffic"), _r1("mean").alias("avg_hourly"),
                    F.col("hi").alias("peak"), F.col("lo").alias("min_traffic"))


def _categories(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return m.select("traffic_category", F.col("n").alias("record_count"), pct("n", grand("n")).alias("pct_of_records"),
                    F.col("total").alias("total_traffic"), _r1("mean").alias("avg_traffic"), F.col("lo").alias("min_traffic"),
                    F.col("hi").alias("max_traffic")).orderBy(field_position("traffic_category", CATEGORY_ORDER))


def _category_shares(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return m.select("traffic_category", F.col("n").alias("records"), pct("n", grand("n")).alias("pct")).orderBy(
        field_position("traffic_category", CATEGORY_ORDER))


def hourly_rows(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return m.select("hour_of_day", hour_label("hour_of_day", named=False).alias("hour_label"), "is_business_hr",
                    F.col("n").alias("observations"), _r1("mean").alias("avg_traffic"), F.col("hi").alias("max_traffic"),
                    F.col("lo").alias("min_traffic"), _r1("std").alias("std_dev_traffic"))


def daily_rows(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return m.select("traffic_date", "day_name", "month_name", "traffic_week", "is_weekend", F.col("n").alias("hourly_readings"),
                    F.col("total").alias("daily_total"), _r1("mean").alias("avg_per_hour"), F.col("hi").alias("peak_hour"),
                    F.col("lo").alias("slowest_hour"), F.col("spikes").alias("spike_hours"))


def monthly_rows(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return m.select("traffic_year", "traffic_month", "month_name", F.col("n").alias("hourly_readings"),
                    F.col("total").alias("total_traffic"), _r1("mean").alias("avg_hourly_traffic"), F.col("hi").alias("peak_traffic"),
                    F.col("lo").alias("min_traffic"), F.col("spikes").alias("spike_count"), F.col("month_days").alias("active_days"))


def _monthly_sorted(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    kpi = monthly_rows(m, cfg)
    rest = [c for c in kpi.columns if c not in month_keys(cfg)]  # without year keys, months of several years tie
    return kpi.orderBy(*month_keys(cfg), *rest)


def _day_type() -> Column:
    return label_if(F.col("is_weekend") == 0, "Weekday", "Weekend").alias("day_type")


def _weekday_weekend(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    return m.select(_day_type(), F.col("n").alias("hourly_readings"), _r1("mean").alias("avg_hourly_traffic"),
                    F.col("total").alias("total_traffic"), F.col("hi").alias("peak_traffic"),
                    pct("total", grand("total")).alias("pct_of_total_traffic")).orderBy("day_type")


def _weekday_weekend_exec(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    whole = F.lit(cfg.grand_total) if cfg.grand_total is not None else grand("total")
    return m.select(_day_type(), F.col("n").alias("records"), _r1("mean").alias("avg_traffic"), F.col("total").alias("total_traffic"),
                    pct("total", whole).alias("pct_of_total")).orderBy("day_type")


def _consistency(m: DataFrame, cfg: TrafficConfig) -> DataFrame:
    cv = ratio("std", "mean")
    return m.select("hour_of_day", _r1("mean").alias("avg_traffic"), _r1("std").alias("std_dev"),
                    F.round(cv * 100, 1).alias("coefficient_of_variation"), stability(cv).alias("traffic_stability"),
                    ).orderBy(F.asc_nulls_first("coefficient_of_variation"), "hour_of_day")


def _days(highest: bool, n: int = 10) -> Callable[[DataFrame, TrafficConfig], DataFrame]:
    order = F.desc if highest else F.asc
    return lambda m, cfg: m.select("traffic_date", "day_name", F.col("total").alias("daily_total")).orderBy(
        order("daily_total"), "traffic_date").limit(n)


SECTIONS = {
    "dataset_overview": Section((), _overview),
    "category_distribution": Section(("traffic_category",), _categories),
    "vw_daily_summary": Section(("traffic_date", "day_name", "month_name", "traffic_week", "is_weekend"), daily_rows),
    "vw_hourly_pattern": Section(("hour_of_day", "is_business_hr"), lambda m, c: hourly_rows(m, c).orderBy("hour_of_day", "is_business_hr")),
    "vw_monthly_kpi": Section(("traffic_year", "traffic_month", "month_name"), _monthly_sorted),
    "weekday_weekend": Section(("is_weekend",), _weekday_weekend),
    "insight_consistency": Section(("hour_of_day",), _consistency),
    "exec_overview": Section((), _overview_short),
    "exec_weekday_weekend": Section(("is_weekend",), _weekday_weekend_exec),
    "exec_top_days": Section(("traffic_date", "day_name"), _days(True)),
    "exec_low_days": Section(("traffic_date", "day_name"), _days(False)),
    "exec_categories": Section(("traffic_category",), _category_shares),
}
#: The aggregate sections of the executive report, in its order (the seventh section lists readings).
EXECUTIVE = ("exec_overview", "vw_monthly_kpi", "vw_hourly_pattern", "exec_weekday_weekend", "exec_top_days", "exec_low_days",
             None, "exec_categories")
EXEC_SETS = tuple(dict.fromkeys(SECTIONS[s].keys for s in EXECUTIVE if s))


def executive_moments(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """The measures behind the seven aggregate sections of the executive report: one scan of the readings."""
    return all_sets(build_cells(r, cfg), EXEC_SETS)


def section_of(rows: DataFrame, name: str, cfg: TrafficConfig) -> DataFrame:
    """A section of the executive report from :func:`executive_moments`."""
    s = SECTIONS[name]
    return s.project(rows.where(F.col("set_id") == EXEC_SETS.index(s.keys)), cfg)


def bench_direct_vs_shared(spark: SparkSession, sf_dir: str, runs: int = 3) -> dict[str, float]:
    """Seconds for the seven sections on the events fixture: one scan each, and all from one scan."""
    from hourwise.config import EVENTS
    from hourwise.plans.catalog import enriched_readings

    names = [s for s in EXECUTIVE if s]

    def direct() -> None:
        r = enriched_readings(spark, sf_dir, "E")
        for s in names:
            SECTIONS[s].direct(r, EVENTS).write.format("noop").mode("overwrite").save()

    def shared() -> None:
        rows = materialize(executive_moments(enriched_readings(spark, sf_dir, "E"), EVENTS))
        for s in names:
            section_of(rows, s, EVENTS).write.format("noop").mode("overwrite").save()

    out = {}
    for name, fn in (("sections_direct_sec", direct), ("sections_one_scan_sec", shared)):
        fn()
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn()
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 4)
    return out
