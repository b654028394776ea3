"""Business insights: hour-of-day and day-level profiles built on grouped aggregates.

Hour-level insights group into at most 24 rows; their windows (running share, 4-hour
sums) run over those 24 rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.config import TrafficConfig
from hourwise.functions.columns import hour_label, ratio, sum_long


# Insight 1 --------------------------------------------------------------------------------
def scaling_windows(r: DataFrame, cfg: TrafficConfig, coverage: float | None = None) -> DataFrame:
    """Hours ranked by their (rounded) mean; share of the day and running share.

    As in the original the *rounded* hourly means are summed.  ``coverage`` (e.g. 80)
    optionally keeps only the hours needed to reach that running share.
    """
    h = r.groupBy("hour_of_day").agg(F.round(F.avg("traffic_count"), 1).alias("avg_traffic"))
    total = F.sum("avg_traffic").over(Window.partitionBy())
    order = Window.orderBy(F.desc("avg_traffic"), F.asc("hour_of_day"))
    running = F.sum("avg_traffic").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = h.select(
        "hour_of_day", "avg_traffic",
        F.round(F.try_divide(F.col("avg_traffic"), total) * 100, 2).alias("pct_of_day_traffic"),
        F.round(F.try_divide(running, total) * 100, 1).alias("cumulative_pct"),
    )
    if coverage is not None:
        # Keep hours until the running share first reaches ``coverage`` (24 rows at most).
        prev = F.lag("cumulative_pct").over(Window.orderBy(F.desc("avg_traffic"), F.asc("hour_of_day")))
        out = (out.withColumn("_prev", F.coalesce(prev, F.lit(0.0)))
               .filter(F.col("_prev") < coverage).drop("_prev"))
    return out.orderBy(F.desc("avg_traffic"), "hour_of_day")


# Insight 2 --------------------------------------------------------------------------------
def maintenance_window(r: DataFrame, cfg: TrafficConfig, hours: int = 4, n: int = 5,
                       wrap: bool = False) -> DataFrame:
    """Start hours whose ``hours``-row window of hourly means has the lowest sum.

    Like the original the frame is row based and truncates after the last hour
    (late start hours sum fewer hours); ``wrap=True`` continues past midnight instead.
    """
    h = r.groupBy("hour_of_day").agg(F.avg("traffic_count").alias("_avg"))
    if wrap:
        # Append the first ``hours - 1`` hour rows again after the last one (<= 24 rows).
        first = F.row_number().over(Window.orderBy("hour_of_day"))
        nxt = h.select("*", first.alias("_rn")).filter(F.col("_rn") < hours).select(
            (F.col("hour_of_day") + 24).alias("hour_of_day"), "_avg")
        h = h.unionByName(nxt)
    w = Window.orderBy("hour_of_day").rowsBetween(Window.currentRow, hours - 1)
    out = h.select(
        F.col("hour_of_day").alias("window_start"),
        F.round("_avg", 1).alias("avg_traffic_in_window"),
        F.round(F.sum("_avg").over(w), 1).alias(f"total_{hours}hr_window_avg"),
    ).filter(F.col("window_start") < 24)
    return out.orderBy(f"total_{hours}hr_window_avg", "window_start").limit(n)


# Insight 3 --------------------------------------------------------------------------------
def anomaly_calendar(r: DataFrame, cfg: TrafficConfig, high: int = 3) -> DataFrame:
    """Days with at least one spike reading, with an alert level (HAVING spikes >= 1)."""
    d = r.groupBy("traffic_date", "day_name", "month_name").agg(
        sum_long("traffic_count").alias("daily_total"),
        sum_long("is_spike").alias("spike_hours"),
    )
    level = F.when(F.col("spike_hours") >= high, F.lit("HIGH ALERT")).otherwise(F.lit("ELEVATED"))
    return (d.filter(F.col("spike_hours") >= 1)
            .select("traffic_date", "day_name", "month_name", "daily_total", "spike_hours", level.alias("alert_level"))
            .orderBy(F.desc("spike_hours"), F.desc("daily_total"), "traffic_date"))


# Insight 4 --------------------------------------------------------------------------------
def weekend_profile(r: DataFrame, cfg: TrafficConfig) -> DataFrame:
    """Per hour: weekday mean, weekend mean, weekend as % of weekday (NULL when undefined)."""
    wd = F.avg(F.when(F.col("is_weekend") == 0, F.col("traffic_count")))
    we = F.avg(F.when(F.col("is_weekend") == 1, F.col("traffic_count")))
    h = r.groupBy("hour_of_day").agg(wd.alias("_wd"), we.alias("_we"))
    return h.select(
        "hour_of_day",
        F.round("_wd", 1).alias("weekday_avg"),
        F.round("_we", 1).alias("weekend_avg"),
        F.round(ratio("_we", "_wd") * 100, 1).alias("weekend_as_pct_of_weekday"),
    ).orderBy("hour_of_day")


def stability(cv: Column, predictable: float = 0.5, moderate: float = 1.0) -> Column:
    """Band of a coefficient of variation; a NULL one fails both tests and lands in 'Volatile' (as in the original)."""
    return (F.when(cv < predictable, F.lit("Predictable")).when(cv < moderate, F.lit("Moderate"))
            .otherwise(F.lit("Volatile")))


# Insight 6 --------------------------------------------------------------------------------
def consistency_score(r: DataFrame, cfg: TrafficConfig, predictable: float = 0.5,
                      moderate: float = 1.0) -> DataFrame:
    """Coefficient of variation (population std-dev / mean) per hour and a stability band.

    The band tests the unrounded ratio; a zero mean gives a NULL ratio, which fails both
    tests and lands in 'Volatile' (as in the original).
    """
    h = r.groupBy("hour_of_day").agg(
        F.avg("traffic_count").alias("_avg"),
        F.stddev_pop("traffic_count").alias("_std"),
    )
    cv = ratio("_std", "_avg")
    return h.select(
        "hour_of_day",
        F.round("_avg", 1).alias("avg_traffic"),
        F.round("_std", 1).alias("std_dev"),
        F.round(cv * 100, 1).alias("coefficient_of_variation"),
        stability(cv, predictable, moderate).alias("traffic_stability"),
    ).orderBy(F.asc_nulls_first("coefficient_of_variation"), "hour_of_day")


# Findings ---------------------------------------------------------------------------------
def findings(rows: DataFrame, sets: Sequence[tuple[str, ...]], hours: int = 4) -> DataFrame:
    """The closing findings of the analysis as text, from the data: log_seq, query_name, finding.

    ``rows`` are the measures by ``sets`` (:func:`hourwise.plans.moments.all_sets` over (), month, day, hour and weekend), a
    few thousand rows.  One aggregate over them takes the arg-max or the sum behind every finding; ties go to the earlier
    month, day or hour.  Findings without data (growth in a single month) are left out.
    """
    of = {s: f"FILTER (WHERE set_id = {i})" for i, s in enumerate(sets)}
    month, day, hour, weekend = of[MONTH_SET], of[DAY_SET], of[("hour_of_day",)], of[("is_weekend",)]
    before = F.lag("total").over(Window.partitionBy("set_id").orderBy("traffic_year", "traffic_month"))
    grown = F.when(F.col("set_id") == sets.index(MONTH_SET), F.try_divide(F.col("total") - before, before) * F.lit(100))
    first = "-traffic_year, -traffic_month"
    best = rows.withColumn("growth", F.round(grown, 1)).agg(
        F.expr(f"max_by(struct(month_name, traffic_year, total), struct(total, {first})) {month}").alias("m"),
        F.expr(f"max_by(struct(traffic_date, total), struct(total, -unix_date(traffic_date))) {day}").alias("d"),
        F.expr(f"max_by(struct(hour_of_day, mean), struct(mean, -hour_of_day)) {hour}").alias("h"),
        F.expr(f"max_by(struct(n, spikes), 1) {of[()]}").alias("s"),
        F.expr(f"struct(sum(total) {weekend} AS every, sum(total) FILTER (WHERE set_id = {sets.index(('is_weekend',))} AND is_weekend = 1) AS free)").alias("w"),
        F.expr(f"sort_array(collect_list(struct(hour_of_day, mean)) {hour})").alias("hours"),
        F.expr(f"max_by(struct(month_name, traffic_year, growth), struct(growth, {first})) FILTER (WHERE growth IS NOT NULL)").alias("g"),
    )
    # the quietest stretch of hours goes on past midnight
    total = f"aggregate(sequence(0, {hours - 1}), 0D, (a, j) -> a + hours[(i + j) % size(hours)].mean)"
    quiet = f"array_min(transform(sequence(0, size(hours) - 1), i -> struct({total} AS total, hours[i].hour_of_day AS start)))"
    best = best.where("s.n > 0").withColumn("q", F.expr(f"CASE WHEN size(hours) > 0 THEN {quiet} END"))
    free = F.round(F.coalesce(F.try_divide(F.col("w.free") * F.lit(100.0), F.col("w.every")), F.lit(0.0)), 1)
    texts = [
        ("Monthly peak", F.concat("m.month_name", F.lit(" "), "m.traffic_year", F.lit(" highest month: "),
                                  F.format_number("m.total", 0), F.lit(" total traffic"))),
        ("Daily peak", F.concat(F.col("d.traffic_date").cast("string"), F.lit(" highest day: "), F.format_number("d.total", 0), F.lit(" visits"))),
        ("Hourly peak", F.concat(hour_label("h.hour_of_day", named=False), F.lit(" average: "), F.format_number(F.round("h.mean"), 0),
                                 F.lit(" visits — peak hour"))),
        ("Spike events", F.concat(F.format_number("s.spikes", 0), F.lit(" spike events detected ("),
                                  F.round(F.col("s.spikes") * F.lit(100.0) / F.col("s.n"), 1).cast("string"), F.lit("% of readings)"))),
        ("Weekday share", F.concat(F.lit("Weekdays = "), F.round(F.lit(100.0) - free, 1).cast("string"),
                                   F.lit("% of all traffic; weekends = "), free.cast("string"), F.lit("%"))),
        ("Maintenance", F.concat(F.lit("Safest window: "), hour_label("q.start", named=False), F.lit(" – "),
                                 hour_label((F.col("q.start") + F.lit(hours - 1)) % 24, named=False), F.lit(" (lowest traffic)"))),
        ("Growth", F.concat("g.month_name", F.lit(" "), "g.traffic_year", F.lit(" growth: "),
                            F.when(F.col("g.growth") >= 0, F.lit("+")).otherwise(F.lit("")), F.col("g.growth").cast("string"),
                            F.lit("% month-over-month"))),
    ]
    listed = F.array(*[F.struct(F.lit(i).alias("log_seq"), F.lit(n).alias("query_name"), t.alias("finding")) for i, (n, t) in enumerate(texts, 1)])
    return best.select(F.inline(listed)).where("finding IS NOT NULL").orderBy("log_seq")


MONTH_SET, DAY_SET = ("traffic_year", "traffic_month", "month_name"), ("traffic_date",)
FINDING_SETS = ((), MONTH_SET, DAY_SET, ("hour_of_day",), ("is_weekend",))
