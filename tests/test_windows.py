"""Scaled global windows (X1, X2) against the plain single-partition windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourwise.operators import ordered, windows
from hourwise.sources.readings import READINGS_SCHEMA


@pytest.fixture(scope="module")
def skewed(spark):
    """600 readings: a third share one count (hot value), timestamps with ties."""
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        count = 0 if i % 3 == 0 else rnd.randint(1, 50)
        rows.append((i + 1, t0 + dt.timedelta(minutes=rnd.randint(0, 300)), count))
    return spark.createDataFrame(rows, READINGS_SCHEMA).cache()


def collect_map(df, key, val):
    return {r[key]: r[val] for r in df.select(key, val).collect()}


@pytest.mark.parametrize("k", [4, 7, 1000])
@pytest.mark.parametrize("buckets", [1, 5, 16])
def test_global_ntile_equals_plain(skewed, k, buckets):
    plain = skewed.withColumn("t", F.ntile(k).over(Window.orderBy("traffic_count", "record_id")))
    scaled = windows.global_ntile(skewed, k, ["traffic_count", "record_id"], out="t", buckets=buckets)
    assert collect_map(scaled, "record_id", "t") == collect_map(plain, "record_id", "t")


def test_global_row_number_is_dense_and_ordered(skewed):
    got = windows.global_row_number(skewed, ["traffic_time", "record_id"], out="rn", buckets=9)
    plain = skewed.withColumn("rn", F.row_number().over(Window.orderBy("traffic_time", "record_id")))
    assert collect_map(got, "record_id", "rn") == collect_map(plain, "record_id", "rn")


@pytest.mark.parametrize("before,after,block", [(1, 1, 1), (1, 1, 7), (6, 0, 6), (0, 3, 5), (2, 2, 1000)])
def test_moving_window_equals_plain(skewed, before, after, block):
    keys = ["traffic_time", "record_id"]
    w = Window.orderBy(*keys).rowsBetween(-before, after)
    plain = skewed.withColumn("m", F.avg("traffic_count").over(w))
    scaled = windows.moving_window(skewed, keys, "traffic_count", before, after, out="m",
                                   block_rows=block, buckets=4)
    a, b = collect_map(scaled, "record_id", "m"), collect_map(plain, "record_id", "m")
    assert a.keys() == b.keys()
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_moving_window_sum_and_count(skewed):
    keys = ["traffic_time", "record_id"]
    w = Window.orderBy(*keys).rowsBetween(-3, 1)
    plain = skewed.withColumn("s", F.count("traffic_count").over(w))
    scaled = windows.moving_window(skewed, keys, "traffic_count", 3, 1, agg="count", out="s", block_rows=3)
    assert collect_map(scaled, "record_id", "s") == collect_map(plain, "record_id", "s")


def test_frame_wider_than_block(spark, skewed):
    w = Window.orderBy("traffic_time", "record_id").rowsBetween(-3, 1)
    out = windows.moving_window(skewed, ["traffic_time", "record_id"], "traffic_count", 3, 1, block_rows=2, out="m")
    assert out.select("record_id", "m").exceptAll(skewed.select("record_id", F.avg("traffic_count").over(w).alias("m"))).isEmpty()


def test_ntile_top_equals_plain_top(skewed):
    plain = (skewed.withColumn("t", F.ntile(4).over(Window.orderBy("traffic_count", "record_id")))
             .orderBy(F.desc("traffic_count"), F.desc("record_id")).limit(30))
    top = windows.ntile_top(skewed, 4, "traffic_count", "record_id", 30, out="t")
    assert collect_map(top, "record_id", "t") == collect_map(plain, "record_id", "t")


def test_moving_head_equals_plain_head(skewed):
    keys = ["traffic_time", "record_id"]
    w = Window.orderBy(*keys).rowsBetween(-1, 1)
    plain = skewed.withColumn("m", F.avg("traffic_count").over(w)).orderBy(*keys).limit(50)
    head = windows.moving_head(skewed, keys, "traffic_count", 1, 1, 50, out="m")
    assert collect_map(head, "record_id", "m") == collect_map(plain, "record_id", "m")


def test_empty_input(spark):
    empty = spark.createDataFrame([], READINGS_SCHEMA)
    assert windows.global_ntile(empty, 4, ["traffic_count", "record_id"]).count() == 0
    assert windows.moving_window(empty, ["traffic_time", "record_id"], "traffic_count", 1, 1).count() == 0


def test_range_buckets_stay_balanced_with_a_hot_value(spark, sf001):
    """A third of the rows share count 0; buckets on (count, record_id) still split them."""
    from hourwise.sources.readings import from_events

    ev = from_events(spark, sf001)
    hot = ev.withColumn("traffic_count", F.when(F.col("record_id") % 3 == 0, F.lit(0))
                        .otherwise(F.col("traffic_count")))
    staged = windows.stage_ordered(hot, ["traffic_count", "record_id"], buckets=16)
    sizes = [r[1] for r in staged.groupBy(F.shiftright("_hw_pos", windows.LOCAL_BITS)).count().collect()]
    n = hot.count()
    assert sum(sizes) == n and len(sizes) >= 12
    assert max(sizes) <= 2.5 * n / 16, sizes


KINDS = {"n": "long", "d": "date", "t": "timestamp", "z": "timestamp_ntz", "m": "decimal(12,3)", "b": "boolean"}


@pytest.fixture(scope="module")
def typed(spark):
    """Keys of every kind with cells, with nulls and values before 1970, behind a unique id."""
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        t = dt.datetime(1969, 12, 30) + dt.timedelta(microseconds=rnd.randint(0, 5 * 86_400_000_000))
        v = [rnd.randint(-(2**62), 2**62), t.date(), t, t, rnd.randint(-9999, 9999), rnd.random() < 0.5]
        rows.append((i, *[None if rnd.random() < 0.1 else x for x in v]))
    df = spark.createDataFrame(rows, "id int, n long, d date, t timestamp, z timestamp_ntz, m int, b boolean")
    return df.withColumn("m", (F.col("m") / 1000).cast("decimal(12,3)")).cache()


@pytest.mark.parametrize("key", list(KINDS))
def test_kinds_of_keys_nulls_first(typed, key):
    keys = [key, "id"]
    plain = typed.withColumn("a", F.ntile(7).over(Window.orderBy(*keys))).withColumn(
        "r", F.row_number().over(Window.orderBy(*keys)))
    assert collect_map(windows.global_ntile(typed, 7, keys, out="a"), "id", "a") == collect_map(plain, "id", "a")
    assert collect_map(windows.global_row_number(typed, keys, out="r", buckets=9), "id", "r") == collect_map(plain, "id", "r")


@pytest.mark.parametrize("keys", [["s", "id"], ["x", "id"], ["id desc"]])
def test_keys_without_cells(typed, keys):
    keys = [F.desc("id")] if keys == ["id desc"] else keys
    df = typed.select("id", F.col("n").cast("string").alias("s"), F.col("n").cast("double").alias("x"), "m")
    w = Window.orderBy(*keys)
    plain = df.withColumn("a", F.ntile(5).over(w)).withColumn("v", F.sum("id").over(w.rowsBetween(-2, 1)))
    assert collect_map(windows.global_ntile(df, 5, keys, out="a", buckets=3), "id", "a") == collect_map(plain, "id", "a")
    got = windows.moving_window(df, keys, "id", 2, 1, agg="sum", out="v", block_rows=5, buckets=3)
    assert collect_map(got, "id", "v") == collect_map(plain, "id", "v")


def test_rows_tied_in_all_keys(spark):
    """Tied rows share out over the tiles as they do in a plain window: by count."""
    df = spark.createDataFrame([(i, 1) for i in range(30)] + [(i, 2) for i in range(30, 37)], "id int, v int")
    got = windows.global_ntile(df, 4, ["v"], out="t", buckets=2).groupBy("t").count().collect()
    assert sorted((r.t, r["count"]) for r in got) == [(1, 10), (2, 9), (3, 9), (4, 9)]


def test_empty_and_one_row(spark):
    for rows in ([], [(1, 5)]):
        df = spark.createDataFrame(rows, "id int, v int")
        assert [(r.id, r.t) for r in windows.global_ntile(df, 4, ["v", "id"], out="t").collect()] == [(i, 1) for i, _ in rows]
        assert [r.n for r in windows.global_row_number(df, ["v", "id"], out="n").collect()] == [1 for _ in rows]
        assert [r.m for r in windows.moving_window(df, ["v", "id"], "v", 1, 1, out="m").collect()] == [5.0 for _ in rows]


def test_buckets_are_bounded_whatever_the_values(skewed):
    """A third of the rows share one value; buckets of at most 10 rows all the same, none much too short."""
    found = ordered.buckets(skewed, ["traffic_count", "record_id"], lambda rows: 10)
    ends = [*found.starts[1:], 600]
    assert max(e - s for s, e in zip(found.starts, ends)) <= 10 and len(found.starts) <= 160


def test_selection_counts_few_cells(skewed, monkeypatch):
    """Levels of two bits: many passes, same cuts."""
    monkeypatch.setattr(ordered, "LEVEL_BITS", 2)
    plain = skewed.withColumn("t", F.ntile(4).over(Window.orderBy("traffic_count", "record_id")))
    got = windows.global_ntile(skewed, 4, ["traffic_count", "record_id"], out="t")
    assert collect_map(got, "record_id", "t") == collect_map(plain, "record_id", "t")
