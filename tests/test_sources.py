"""Sources and sinks: CSV import, audit log, report writing, enriched table."""

import datetime as dt
import os

from pyspark.sql import functions as F

from hourwise.config import EVENTS, REFERENCE
from hourwise.operators.enrich import enrich
from hourwise.plans import reports
from hourwise.sources import readings as src
from hourwise.sources.audit import SETUP_ENTRY, SUMMARY_ENTRIES, AuditLog
from micro import micro_readings


def test_csv_counts_written_as_decimals(spark, scratch):
    path = os.path.join(scratch, "readings.csv")
    with open(path, "w") as f:
        f.write("Timestamp,TrafficCount\n2020-01-20 11:00:00,8591.0\n2020-01-20 10:00:00,17.0\n"
                "2020-01-20 12:30:00,0.0\n")
    df = src.read_csv(spark, path).orderBy("record_id").collect()
    assert [(r.record_id, r.traffic_time, r.traffic_count) for r in df] == [  # import order
        (1, dt.datetime(2020, 1, 20, 11), 8591), (2, dt.datetime(2020, 1, 20, 10), 17),
        (3, dt.datetime(2020, 1, 20, 12, 30), 0)]
    assert dict(src.read_csv(spark, path).dtypes) == {
        "record_id": "bigint", "traffic_time": "timestamp_ntz", "traffic_count": "int"}


def test_csv_round_trip_of_events(spark, sf0001, scratch):
    base = src.from_events(spark, sf0001)
    out = os.path.join(scratch, "events_csv")
    src.write_csv(base, out)
    back = src.read_csv(spark, out)
    assert back.count() == base.count()
    agg = back.agg(F.sum("traffic_count"), F.min("record_id"), F.max("record_id")).first()
    assert agg[0] == base.agg(F.sum("traffic_count")).first()[0]
    assert (agg[1], agg[2]) == (1, base.count())


def test_csv_keys_follow_files_and_splits(spark, scratch):
    """Several files of several splits, packed into tasks by size: keys are the import order, the same in every read,
    and no reading is shuffled or sorted."""
    counts = {"a.csv": 400, "b.csv": 3, "c.csv": 900, "d.csv": 0}
    lines = []
    os.makedirs(os.path.join(scratch, "in"))
    for name, n in counts.items():
        mine = [f"2020-01-20 11:00:{i % 60:02d},{(7919 * i + len(name)) % 1000}.0" for i in range(n)]
        lines += mine
        with open(os.path.join(scratch, "in", name), "w") as f:
            f.write("Timestamp,TrafficCount\n" + "".join(x + "\n" for x in mine))
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = src.read_csv(spark, os.path.join(scratch, "in"))
        for _ in range(2):
            got = sorted((r.record_id, f"{r.traffic_time},{r.traffic_count}.0") for r in df.collect())
            assert got == list(enumerate(lines, 1))
        assert df.where("traffic_count > 500").select("record_id").count() == sum(float(x.split(",")[1]) > 500 for x in lines)
        assert df.rdd.getNumPartitions() > 5
        tree = src.read_csv(spark, os.path.join(scratch, "in"))._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in tree and "BroadcastHashJoin" in tree
        assert tree.count("Exchange hashpartitioning") == tree.count("Exchange hashpartitioning(_hw_file") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_not_null_is_enforced(spark, scratch):
    path = os.path.join(scratch, "bad.csv")
    with open(path, "w") as f:
        f.write("Timestamp,TrafficCount\n2020-01-20 11:00:00,\n")
    try:
        src.read_csv(spark, path).collect()
    except Exception as e:  # noqa: BLE001
        assert "NULL in NOT NULL column traffic_count" in str(e)
    else:
        raise AssertionError("NULL count accepted")


def test_load_check(spark):
    row = src.count_readings(micro_readings(spark), expected=12).first()
    assert (row.total_records, row.matches_expected) == (12, True)
    assert src.count_readings(micro_readings(spark), expected=2793).first().matches_expected is False


def test_audit_log_nine_rows_in_order(spark, scratch):
    log = AuditLog(spark, os.path.join(scratch, "audit_log"))
    log.append([SETUP_ENTRY])
    log.append(SUMMARY_ENTRIES)
    rows = log.read().collect()
    assert [(r.query_name, r.finding) for r in rows] == [SETUP_ENTRY, *SUMMARY_ENTRIES]
    assert len({r.log_id for r in rows}) == 9
    assert dict(log.read().dtypes)["logged_at"] == "timestamp_ntz"


def test_reports_log_like_the_original(spark, scratch):
    r = enrich(micro_readings(spark), REFERENCE)
    log = AuditLog(spark, os.path.join(scratch, "log"))
    reports.daily_report(r, REFERENCE, "2021-01-03").write(os.path.join(scratch, "daily"), log)
    reports.range_report(r, REFERENCE, "2021-01-01", "2021-01-04").write(os.path.join(scratch, "range"), log)
    ex = reports.executive_report(r, REFERENCE)
    assert list(ex.sections)[0] == "=== 1. DATASET OVERVIEW ==="
    ex.write(os.path.join(scratch, "exec"), log)
    names = [x.query_name for x in log.read().collect()]
    assert names == ["sp_daily_report(2021-01-03)", "sp_executive_report"]
    hours = spark.read.parquet(os.path.join(scratch, "daily", "hours")).collect()
    assert len(hours) == 3
    summary = spark.read.parquet(os.path.join(scratch, "range", "summary")).first()
    assert (summary.days_in_range, summary.hourly_readings) == (4, 8)


def test_spike_marker(spark):
    r = enrich(micro_readings(spark), REFERENCE)
    flags = [x.spike_flag for x in reports.day_hours(r, REFERENCE, "2021-01-11").collect()]
    assert flags == ["⚠ SPIKE"]


def test_stored_enriched_table_prunes_days(spark, sf0001, scratch):
    import contextlib
    import io

    base = src.from_events(spark, sf0001)
    out = os.path.join(scratch, "enriched")
    src.write_enriched(base, EVENTS, out)
    stored = src.read_enriched(spark, out)
    live = enrich(base, EVENTS)
    assert stored.dtypes == live.dtypes
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, live.collect()))
    # A day report over the stored table reads one day folder for its filtered part.
    rep = reports.day_hours(stored, EVENTS, "2024-01-02")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        rep.explain("formatted")
    assert "PartitionFilters: [isnotnull(traffic_date" in buf.getvalue()
    assert rep.first() == reports.day_hours(live, EVENTS, "2024-01-02").first()
