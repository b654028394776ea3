"""Streaming day summary / spike feed equal the batch operators on the same readings."""

import os

from pyspark.sql import functions as F

from hourwise.config import EVENTS
from hourwise.operators.enrich import count_stats
from hourwise.plans import views
from hourwise.operators.enrich import enrich
from hourwise.sources.readings import from_events
from hourwise.streaming import live


def test_stream_matches_batch(spark, sf0001, scratch):
    base = from_events(spark, sf0001)
    # Write the readings as several files so the stream sees several micro-batches.
    src = os.path.join(scratch, "in")
    base.repartition(4, "record_id").write.parquet(src)
    st = count_stats(base).first()
    cfg = EVENTS.with_(spike_threshold=st.mean_count + 2.0 * st.std_count, z_mean=st.mean_count, z_std=st.std_count)

    stream = live.readings_stream(spark, src, max_files_per_trigger=1)
    q = (live.daily_summary_stream(stream, cfg).writeStream.outputMode("complete").format("memory")
         .queryName("daily_live").option("checkpointLocation", os.path.join(scratch, "ck1")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("daily_live").collect()))
    want = sorted(map(tuple, views.daily_summary(enrich(base, cfg), cfg).collect()))
    assert got == want

    q2 = (live.spike_stream(live.readings_stream(spark, src), cfg).writeStream.format("memory")
          .queryName("spikes_live").option("checkpointLocation", os.path.join(scratch, "ck2")).start())
    q2.processAllAvailable()
    q2.stop()
    n_batch = enrich(base, cfg).filter(F.col("is_spike") == 1).count()
    assert spark.table("spikes_live").count() == n_batch > 0


def test_watermark_closes_days(spark, scratch):
    """Days close once the watermark (max event time - 1 day) passes their end; a reading
    for a closed day arriving in a later micro-batch is dropped, a reading for an open
    day is counted.  (Spark filters late rows with the previous batch's watermark.)"""
    import datetime as dt

    from hourwise.config import REFERENCE
    from hourwise.sources.readings import READINGS_SCHEMA

    t = dt.datetime
    batches = [
        [(1, t(2024, 1, 1, 10), 100), (2, t(2024, 1, 2, 10), 200), (3, t(2024, 1, 5, 12), 300)],
        [(4, t(2024, 1, 9, 0), 1)],
        [(5, t(2024, 1, 1, 11), 1000), (6, t(2024, 1, 7, 20), 400)],
    ]
    src = os.path.join(scratch, "late")
    for rows in batches:
        spark.createDataFrame(rows, READINGS_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = live.readings_stream(spark, src, max_files_per_trigger=1)
    q = (live.daily_summary_stream(stream, REFERENCE).writeStream.outputMode("append").format("memory")
         .queryName("late_live").option("checkpointLocation", os.path.join(scratch, "ck3")).start())
    q.processAllAvailable()
    progress = [(p["numInputRows"], p.get("eventTime", {}).get("watermark")) for p in q.recentProgress]
    q.stop()
    got = {r.traffic_date: r.daily_total for r in spark.table("late_live").collect()}
    assert got[dt.date(2024, 1, 1)] == 100, (got, progress)  # the late 1000 was dropped
    assert got[dt.date(2024, 1, 7)] == 400, (got, progress)  # within the lateness bound
    assert dt.date(2024, 1, 9) not in got                    # still open: not final yet


def test_stream_needs_fixed_statistics(spark, scratch):
    import pytest

    from hourwise.config import EVENTS
    from hourwise.sources.readings import READINGS_SCHEMA

    src = os.path.join(scratch, "empty")
    spark.createDataFrame([], READINGS_SCHEMA).write.parquet(src)
    stream = live.readings_stream(spark, src)
    with pytest.raises(ValueError):
        live.daily_summary_stream(stream, EVENTS)  # computed threshold: not a constant on a stream
    with pytest.raises(ValueError):
        live.spike_stream(stream, EVENTS.with_(spike_threshold=100.0))  # z-score scale missing
