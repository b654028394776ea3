"""The four views kept current by micro-batches.

Every batch leaves three small results in folders named by its id: the statistics of its counts, its cells (partial aggregates by
day, hour and band, see :mod:`hourwise.plans.moments`) and its spike readings.  A folder is overwritten when Spark replays the
batch, so a replay changes nothing.  The views merge the cells of all batches: counts, sums, extremes, deviations and days are
those of one pass over all readings.

With a computed threshold a reading is a spike by the statistics of all batches up to its own, as a live feed has to decide;
they are merged from the stored statistics, so no key holds state for the whole stream in one task.  With a configured threshold
the views equal those of a batch run.

:meth:`ViewStore.compact` folds the cells and statistics of finished batches into one, so reading costs the cells, not the
batches ever seen.  Readings may come in any order; late ones simply add to their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.config import TrafficConfig
from hourwise.functions.columns import flag
from hourwise.operators.enrich import enrich
from hourwise.operators.stats import part_stats, threshold_of
from hourwise.plans import moments

STATS = "n long, total long, m2 double"
CELLS = ("traffic_date date, hour_of_day int, traffic_category string, n long, total long, lo int, hi int, spikes long, "
         "first_time timestamp_ntz, last_time timestamp_ntz, m2 double")
SPIKES = ("record_id long, traffic_time timestamp_ntz, traffic_date date, day_name string, hour_of_day int, month_name string, "
          "traffic_count int, z_score double")


class ViewStore:
    def __init__(self, spark: SparkSession, path: str, cfg: TrafficConfig):
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg

    def add(self, readings: DataFrame, batch: int) -> None:
        """The function for ``writeStream.foreachBatch``: readings of one micro-batch (record_id, traffic_time, traffic_count)."""
        self._write(part_stats(readings), "stats", batch)
        threshold, mean, std = threshold_of(self._parts("stats", STATS, batch), self.cfg)
        r = enrich(readings, self.cfg.with_(spike_threshold=0)).drop("is_spike")
        r = r.withColumn("is_spike", flag(F.col("traffic_count") > threshold))
        self._write(self._plain(moments.build_cells(r, self.cfg)), "cells", batch)
        z = F.round(F.try_divide(F.col("traffic_count") - mean, std), 2)
        spikes = r.where("is_spike = 1").withColumn("z_score", z)
        self._write(spikes.select(*[c.split()[0] for c in SPIKES.split(", ")]), "spikes", batch)

    def _write(self, df: DataFrame, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def _parts(self, kind: str, schema: str, upto: int | None = None) -> DataFrame:
        """Rows of a kind of result by batch: the last fold, and the batches behind it."""
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{kind}")
        folded = self._folds(kind, schema)
        if folded is not None:
            last = folded.agg(F.max("upto")).first()[0]  # one number
            rows = rows.where(F.col("batch") > last).unionByName(
                folded.where(F.col("upto") == last).withColumnRenamed("upto", "batch"))
        return rows if upto is None else rows.where(F.col("batch") <= upto)

    def _folds(self, kind: str, schema: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema(f"{schema}, upto long").parquet(f"{self.path}/{kind}-folded")
            return rows if rows.take(1) else None
        except AnalysisException:  # never folded
            return None

    @staticmethod
    def _plain(cells: DataFrame) -> DataFrame:
        return cells.select(*[c.split()[0] for c in CELLS.split(", ")])

    def _merged(self, rows: DataFrame) -> DataFrame:
        """Cells of several batches as one cell each."""
        mean = "sum(total) OVER (PARTITION BY {0}) / sum(n) OVER (PARTITION BY {0})".format(", ".join(moments.CELL_KEYS))
        d = rows.withColumn("d", F.col("total") / F.col("n") - F.expr(mean))
        return self._plain(d.groupBy(*moments.CELL_KEYS).agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.sum("spikes").alias("spikes"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
            F.expr("sum(m2) + sum(n * d * d)").alias("m2")))

    def compact(self, upto: int) -> None:
        """Folds all batches up to ``upto`` (finished ones: they must not be replayed any more) into one."""
        cells = self._merged(self._parts("cells", CELLS, upto))
        stats = self._parts("stats", STATS, upto).where("n > 0")
        every = "sum(total) OVER () / sum(n) OVER ()"  # a few numbers a batch
        stats = stats.withColumn("d", F.col("total") / F.col("n") - F.expr(every)).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"), F.expr("sum(m2) + sum(n * d * d)").alias("m2"))
        cells.write.mode("overwrite").parquet(f"{self.path}/cells-folded/upto={upto}")
        stats.write.mode("overwrite").parquet(f"{self.path}/stats-folded/upto={upto}")

    def cells(self) -> DataFrame:
        """All cells, with the calendar columns that the sections group by."""
        return moments.with_calendar(self._merged(self._parts("cells", CELLS)), self.cfg)

    def view(self, name: str) -> DataFrame:
        """One of the four views, as of the last finished batch."""
        if name == "vw_spike_events":
            return self.spark.read.schema(SPIKES).parquet(f"{self.path}/spikes")
        return moments.SECTIONS[name].from_cells(self.cells(), self.cfg)
