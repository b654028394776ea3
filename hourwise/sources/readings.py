"""Readings sources: the typed base table ``(record_id, traffic_time, traffic_count)``.

* :func:`read_csv` - the original ``Timestamp,TrafficCount`` CSV export.
* :func:`from_events` / :func:`from_orders` - readings derived from the test tables.
* :func:`write_enriched` - the enriched table as Parquet partitioned by day.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwise.config import TrafficConfig
from hourwise.functions.columns import count_all
from hourwise.operators.enrich import enrich

READINGS_SCHEMA = T.StructType([
    T.StructField("record_id", T.LongType(), False),
    T.StructField("traffic_time", T.TimestampNTZType(), False),
    T.StructField("traffic_count", T.IntegerType(), False),
])

# The CSV has a datetime text column and a count written like ``8591.0``: read it as a
# double (ANSI Spark refuses ``cast('8591.0' as int)``) and cast after rounding.
CSV_SCHEMA = "Timestamp timestamp_ntz, TrafficCount double"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def not_null(c: str, name: str | None = None) -> Column:
    """``c``, failing the task on a NULL (the NOT NULL constraint of the table DDL).

    Spark's file readers do not enforce nullability; this keeps the check lazy and
    inside the scan stage instead of running a separate validation job.
    """
    name = name or c
    return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"NULL in NOT NULL column {name}"))).otherwise(F.col(c))


def count_from_double(c: str | Column) -> Column:
    """Integral count from a double column: ``round`` half-up, then ``int``."""
    cc = F.col(c) if isinstance(c, str) else c
    return F.round(cc).cast("int")


# Columns read from the test tables, declared so no Parquet footer is read for a schema.
EVENTS_READ_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, value DOUBLE"
ORDERS_READ_SCHEMA = "o_orderkey BIGINT, o_orderdate TIMESTAMP_NTZ, o_totalprice DOUBLE"


def _readings(spark: SparkSession, path: str, schema: str, key: str, time: str, count_sql: str,
              strict: bool) -> DataFrame:
    src = spark.read.schema(schema).parquet(path)
    if strict:
        src = src.select(*[not_null(c).alias(c) for c in src.columns])
    return src.selectExpr(f"{key} AS record_id", f"{time} AS traffic_time",
                          f"CAST(round({count_sql}) AS INT) AS traffic_count")


def from_events(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    """Readings of the ``events`` table: one reading per event, count = ``round(value*100)``.

    ``strict`` enforces the NOT NULL constraint row by row (it hides the columns from
    Parquet filter pushdown, so the query pipeline leaves it off).
    """
    return _readings(spark, table_path(sf_dir, "events"), EVENTS_READ_SCHEMA, "event_id", "ts",
                     "value * 100", strict)


def from_orders(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    """Readings of the ``orders`` table: one reading per order day-stamp, count = ``round(price)``."""
    return _readings(spark, table_path(sf_dir, "orders"), ORDERS_READ_SCHEMA, "o_orderkey", "o_orderdate",
                     "o_totalprice", strict)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The original CSV export (``Timestamp,TrafficCount`` with a header).

    The file has no key; ``record_id`` is the 1-based import order (the auto-increment key of the original import): files by
    name, rows as they stand in them.  Rows are counted by file split in a first pass, the counts are summed up in the order
    of (file, start of the split), and a row's number is its split's offset plus its place there.  The splits, one row for
    each piece of a file that a task reads, are the only thing that is shuffled, sorted and broadcast; readings stay where
    they are scanned.
    """
    raw = spark.read.schema(CSV_SCHEMA).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    rows = raw.select("*", F.monotonically_increasing_id().alias("_hw_id"), F.col("_metadata.file_path").alias("_hw_file"),
                      F.col("_metadata.file_block_start").alias("_hw_from"))
    # a task reads its splits one after the other, so the ids of a split have no gaps
    splits = rows.groupBy("_hw_file", "_hw_from").agg(F.min("_hw_id").alias("_hw_first"), count_all().alias("_hw_n"))
    ahead = F.sum("_hw_n").over(Window.orderBy("_hw_file", "_hw_from").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("_hw_file", "_hw_from", (F.coalesce(ahead, F.lit(0)) - F.col("_hw_first") + 1).alias("_hw_ahead"))
    # size bound: one row a split, 200,000 for 100 TB in splits of 512 MB
    numbered = rows.join(F.broadcast(offsets), ["_hw_file", "_hw_from"])
    return numbered.select(
        (F.col("_hw_id") + F.col("_hw_ahead")).alias("record_id"),
        not_null("Timestamp", "traffic_time").alias("traffic_time"),
        count_from_double(not_null("TrafficCount", "traffic_count")).alias("traffic_count"),
    )


def write_csv(readings: DataFrame, path: str) -> None:
    """Write readings in the original CSV layout (``Timestamp,TrafficCount``, counts as ``n.0``).

    Times keep their microseconds (``2024-01-01 00:00:07.179575``) so a round trip is exact.
    """
    (readings.select(
        F.date_format("traffic_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
        F.col("traffic_count").cast("double").alias("TrafficCount"),
    ).write.mode("overwrite").option("header", True).csv(path))


def write_enriched(readings: DataFrame, cfg: TrafficConfig, path: str, buckets: int | None = None) -> None:
    """Store the enriched table (the original keeps its derived columns stored).

    Partitioned by ``traffic_date`` so day and date-range reports prune whole folders.
    Rows are range-partitioned on ``(traffic_date, traffic_time, record_id)`` first: each
    write task covers a contiguous stretch of days (a few folders, few files), and a day
    holding a third of all readings is split over many tasks instead of one.
    """
    from hourwise.operators.windows import default_buckets

    r = enrich(readings, cfg)
    n = buckets or default_buckets(readings)
    (r.repartitionByRange(n, "traffic_date", "traffic_time", "record_id")
     .write.mode("overwrite").partitionBy("traffic_date").parquet(path))


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """The stored enriched table, columns in the usual order.

    Day and date-range filters on ``traffic_date`` become partition filters (whole day
    folders are skipped), and ``is_spike`` is read, not recomputed: no statistics pass.
    """
    from hourwise.operators.enrich import ENRICHED_COLUMNS

    return spark.read.parquet(path).select(*ENRICHED_COLUMNS)


def count_readings(readings: DataFrame, expected: int | None = None) -> DataFrame:
    """Load check: ``COUNT(*) AS total_records`` (plus ``matches_expected`` when given)."""
    out = readings.agg(count_all().alias("total_records"))
    if expected is not None:
        out = out.withColumn("matches_expected", F.col("total_records") == F.lit(expected))
    return out


def preview(readings: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` readings in time order (``record_id`` breaks ties)."""
    return readings.orderBy("traffic_time", "record_id").limit(n)
