"""The stored enriched table, refreshed by day.

``rows`` holds the readings with their derived columns, partitioned by day; ``days`` holds n, total and M2 of each day's counts.
:meth:`EnrichedTable.replace_days` overwrites the partitions of the days it is given (dynamic partition overwrite) and touches no
other day.  A computed spike threshold depends on all days, so ``is_spike`` is not stored then: the reader compares the stored
count with the threshold merged from the day statistics, a few thousand rows.  After a changed day every other day's flag is
right again without rewriting it, and no reading is scanned for statistics.

A call that failed half way is repaired by repeating it.  Days without new readings stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.config import TrafficConfig
from hourwise.functions.columns import flag
from hourwise.operators.enrich import ENRICHED_COLUMNS, enrich
from hourwise.operators.stats import part_stats, threshold_of


class EnrichedTable:
    def __init__(self, spark: SparkSession, path: str, cfg: TrafficConfig):
        self.spark, self.cfg = spark, cfg
        self.rows_path, self.days_path = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/days"

    def replace_days(self, readings: DataFrame, buckets: int | None = None) -> None:
        """Stores every day of ``readings`` as it is there, new days and known ones alike.

        Rows are range-partitioned on (day, time, id): a task writes a few day folders, a hot day is many tasks' work."""
        from hourwise.operators.windows import default_buckets

        r = enrich(readings, self.cfg)
        if self.cfg.spike_threshold is None:
            r = r.drop("is_spike")
        n = buckets or default_buckets(readings)
        rows = r.repartitionByRange(n, "traffic_date", "traffic_time", "record_id")
        days = part_stats(readings, F.to_date("traffic_time").alias("traffic_date"))
        for df, path in ((rows, self.rows_path), (days, self.days_path)):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("traffic_date").parquet(path)

    def day_stats(self) -> DataFrame:
        return self.spark.read.schema("n long, total long, m2 double, traffic_date date").parquet(self.days_path)

    def read(self) -> DataFrame:
        """The enriched readings; day filters on ``traffic_date`` skip whole folders."""
        rows = self.spark.read.parquet(self.rows_path)
        if self.cfg.spike_threshold is None:
            threshold, _, _ = threshold_of(self.day_stats(), self.cfg)
            rows = rows.withColumn("is_spike", flag(F.col("traffic_count") > threshold))
        return rows.select(*ENRICHED_COLUMNS)
