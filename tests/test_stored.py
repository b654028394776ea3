"""The stored enriched table, views kept by micro-batches, and findings."""

import datetime as dt
import os
import statistics

import pytest
from pyspark.sql import functions as F

from hourwise.config import EVENTS, REFERENCE
from hourwise.operators import insights
from hourwise.operators.enrich import enrich
from hourwise.operators.stats import part_stats, union_stats
from hourwise.plans import moments, views
from hourwise.sources.readings import READINGS_SCHEMA, from_events
from hourwise.sources.stored import EnrichedTable
from hourwise.streaming.live import readings_stream
from hourwise.streaming.refresh import ViewStore

T = dt.datetime


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def readings(spark, rows):
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows, 1)], READINGS_SCHEMA)


def test_merged_statistics(spark):
    values = [3, 3, 50, 1000, 0, 7, 7, 7, 123456]
    df = spark.createDataFrame([(i % 3, c) for i, c in enumerate(values)], "part int, traffic_count int")
    got = union_stats(part_stats(df, "part")).first()
    assert got.n == 9 and got.mean_count == pytest.approx(statistics.fmean(values)) and got.std_count == pytest.approx(statistics.pstdev(values))
    none = union_stats(part_stats(df.limit(0))).first()
    assert tuple(none) == (0, None, None)


@pytest.mark.parametrize("cfg", [EVENTS, REFERENCE])
def test_replaced_day(spark, sf0001, scratch, cfg):
    base = from_events(spark, sf0001)
    day = dt.date(2024, 1, 3)
    on_day = F.to_date("traffic_time") == F.lit(day)
    table = EnrichedTable(spark, scratch, cfg)
    table.replace_days(base.where(~on_day))  # the day is missing at first
    files = lambda d: sorted(os.listdir(os.path.join(scratch, "rows", f"traffic_date={d}")))
    other = files("2024-01-05")
    fixed = base.where(on_day).withColumn("traffic_count", F.col("traffic_count") * 50)
    for _ in range(2):  # the second time is a repeated run
        table.replace_days(fixed, buckets=2)
    want = enrich(base.withColumn("traffic_count", F.when(on_day, F.col("traffic_count") * 50).otherwise(F.col("traffic_count"))), cfg)
    got = table.read()
    assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want)
    assert files("2024-01-05") == other  # other days are not written again
    tree = table.read().where(F.col("traffic_date") == F.lit(day))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(traffic_date" in tree
    # the threshold comes from the day statistics: no scan of counts
    assert tree.count("/rows]") == 1


def batches(spark, sf):
    base = from_events(spark, sf)
    return [base.where(F.pmod("record_id", F.lit(4)) == i) for i in (2, 0, 3, 1)], base


def test_views_by_batch_equal_batch_views(spark, sf0001, scratch):
    parts, base = batches(spark, sf0001)
    cfg = EVENTS.with_(spike_threshold=12000, z_mean=5000.0, z_std=4000.0)
    store = ViewStore(spark, scratch, cfg)
    r = enrich(base, cfg)
    want = {
        "vw_daily_summary": views.daily_summary(r, cfg), "vw_hourly_pattern": views.hourly_pattern_view(r, cfg),
        "vw_monthly_kpi": views.monthly_kpi(r, cfg), "vw_spike_events": views.spike_events(r, cfg),
    }
    for i, part in enumerate(parts):
        store.add(part, i)
        if i == 1:
            store.add(parts[1], 1)  # replayed
            store.compact(1)
    store.add(parts[3], 3)
    for _ in range(2):
        for name, w in want.items():
            got = store.view(name)
            assert got.select(*w.columns).dtypes == w.dtypes, name
            assert rows_of(got.select(*w.columns)) == rows_of(w), name
        store.compact(3)


def test_views_from_a_stream(spark, sf0001, scratch):
    base = from_events(spark, sf0001)
    base.repartition(3, "record_id").write.parquet(os.path.join(scratch, "in"))
    cfg = EVENTS.with_(spike_threshold=12000)
    store = ViewStore(spark, os.path.join(scratch, "views"), cfg)
    q = (readings_stream(spark, os.path.join(scratch, "in"), max_files_per_trigger=1).writeStream.foreachBatch(store.add)
         .option("checkpointLocation", os.path.join(scratch, "ck")).start())
    q.processAllAvailable()
    q.stop()
    assert rows_of(store.view("vw_daily_summary")) == rows_of(views.daily_summary(enrich(base, cfg), cfg))
    assert len(os.listdir(os.path.join(scratch, "views", "cells"))) >= 3


def test_computed_threshold_as_of_each_batch(spark, scratch):
    """A reading is judged by all readings of its own and earlier batches; a replay judges alike."""
    cfg = EVENTS.with_(spike_k=1.0)
    day = T(2024, 1, 1)
    counts = [[10, 12, 11, 30], [10, 11, 400, 12], [], [390, 10, 10, 10]]
    rows = [[(day + dt.timedelta(hours=4 * b + i), c) for i, c in enumerate(cs)] for b, cs in enumerate(counts)]
    store, seen, want = ViewStore(spark, scratch, cfg), [], []
    frames = [readings(spark, x) for x in rows]
    for b, df in enumerate(frames):
        store.add(df, b)
        seen += counts[b]
        mean, std = statistics.fmean(seen), statistics.pstdev(seen)
        want += [(t, c, round((c - mean) / std, 2)) for t, c in rows[b] if c > mean + std]
    store.add(frames[1], 1)  # replayed after later batches
    got = store.view("vw_spike_events")
    assert sorted((x.traffic_time, x.traffic_count, x.z_score) for x in got.collect()) == want and len(want) == 3
    assert store.view("vw_daily_summary").first().spike_hours == 3


def findings_of(spark, rows, cfg=REFERENCE):
    r = enrich(readings(spark, rows), cfg)
    out = insights.findings(moments.all_sets(moments.build_cells(r, cfg), insights.FINDING_SETS), insights.FINDING_SETS)
    return [(x.query_name, x.finding) for x in out.collect()]


def test_findings_by_hand(spark):
    rows = [(T(2020, 1, 31, 23), 1000), (T(2020, 2, 1, 11, 30), 40000), (T(2020, 2, 3, 11), 1234), (T(2020, 2, 3, 1), 6)]
    assert findings_of(spark, rows) == [
        ("Monthly peak", "February 2020 highest month: 41,240 total traffic"),
        ("Daily peak", "2020-02-01 highest day: 40,000 visits"),
        ("Hourly peak", "11 AM average: 20,617 visits — peak hour"),
        ("Spike events", "1 spike events detected (25.0% of readings)"),
        ("Weekday share", "Weekdays = 5.3% of all traffic; weekends = 94.7%"),
        ("Maintenance", "Safest window: 1 AM – 4 AM (lowest traffic)"),
        ("Growth", "February 2020 growth: +4024.0% month-over-month"),
    ]


def test_findings_without_data(spark):
    assert findings_of(spark, []) == []
    one = dict(findings_of(spark, [(T(2020, 1, 6, 0), 0)]))
    assert "Growth" not in one and one["Weekday share"] == "Weekdays = 100.0% of all traffic; weekends = 0.0%"
