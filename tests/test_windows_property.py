"""Randomised checks: scaled windows equal the plain windows for any frame, block size,
bucket count and data shape (hot values, tied times, tiny inputs)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourwise.operators import windows
from hourwise.sources.readings import READINGS_SCHEMA

T0 = dt.datetime(2024, 1, 1)

rows_strategy = st.lists(
    st.tuples(st.integers(0, 40), st.sampled_from([0, 0, 0, 1, 5, 17, 500])), min_size=1, max_size=60)


def frame(spark, rows):
    data = [(i + 1, T0 + dt.timedelta(minutes=m), c) for i, (m, c) in enumerate(rows)]
    return spark.createDataFrame(data, READINGS_SCHEMA)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_strategy, before=st.integers(0, 3), after=st.integers(0, 3),
       block=st.integers(1, 9), buckets=st.integers(1, 6))
def test_moving_window_property(spark, rows, before, after, block, buckets):
    """Buckets of one row up, so frames reach over several of them."""
    df = frame(spark, rows)
    keys = ["traffic_time", "record_id"]
    w = Window.orderBy(*keys).rowsBetween(-before, after)
    want = {r.record_id: r.m for r in df.withColumn("m", F.sum("traffic_count").over(w)).collect()}
    got = {r.record_id: r.m for r in windows.moving_window(df, keys, "traffic_count", before, after, agg="sum",
                                                            out="m", block_rows=block, buckets=buckets).collect()}
    assert got == want


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_strategy, k=st.integers(1, 9), buckets=st.integers(1, 6))
def test_ntile_property(spark, rows, k, buckets):
    df = frame(spark, rows)
    keys = ["traffic_count", "record_id"]
    want = {r.record_id: r.t for r in df.withColumn("t", F.ntile(k).over(Window.orderBy(*keys))).collect()}
    got = {r.record_id: r.t for r in windows.global_ntile(df, k, keys, out="t", buckets=buckets).collect()}
    assert got == want


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_strategy, k=st.integers(1, 6), n=st.integers(1, 40))
def test_ntile_top_property(spark, rows, k, n):
    """Top-n rows with their NTILE(k), including tables smaller than n."""
    df = frame(spark, rows)
    plain = (df.withColumn("t", F.ntile(k).over(Window.orderBy("traffic_count", "record_id")))
             .orderBy(F.desc("traffic_count"), F.desc("record_id")).limit(n))
    top = windows.ntile_top(df, k, "traffic_count", "record_id", n, out="t")
    assert {r.record_id: r.t for r in top.collect()} == {r.record_id: r.t for r in plain.collect()}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_strategy, n=st.integers(1, 40))
def test_moving_head_property(spark, rows, n):
    """First-n moving averages, including tables smaller than n + 1."""
    df = frame(spark, rows)
    keys = ["traffic_time", "record_id"]
    w = Window.orderBy(*keys).rowsBetween(-1, 1)
    plain = df.withColumn("m", F.avg("traffic_count").over(w)).orderBy(*keys).limit(n)
    head = windows.moving_head(df, keys, "traffic_count", 1, 1, n, out="m")
    assert {r.record_id: r.m for r in head.collect()} == {r.record_id: r.m for r in plain.collect()}
