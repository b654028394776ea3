"""One set of measures behind the sections: from readings, from cells, and from one scan for all of them."""

import os
import re

import pytest

from hourwise.config import EVENTS, REFERENCE
from hourwise.operators.enrich import enrich
from hourwise.plans import moments, reports, views
from hourwise.plans.catalog import FIXTURES, enriched_readings
from hourwise.sources.audit import AuditLog
from micro import micro_readings


@pytest.fixture(scope="module")
def both(spark, sf001):
    r = enriched_readings(spark, sf001, "E")
    return r, moments.materialize(moments.build_cells(r, EVENTS))


@pytest.mark.parametrize("key", sorted(moments.SECTIONS))
def test_cells_equal_readings(both, key):
    r, cells = both
    direct = moments.SECTIONS[key].direct(r, EVENTS)
    shared = moments.SECTIONS[key].from_cells(cells, EVENTS)
    assert shared.dtypes == direct.dtypes
    assert sorted(map(tuple, shared.collect()), key=repr) == sorted(map(tuple, direct.collect()), key=repr)


def test_cells_are_small(both):
    r, cells = both
    assert cells.count() <= r.select("traffic_date").distinct().count() * 24 * 4


@pytest.mark.parametrize("fixture", ["E", "O", "EP", "OP"])
def test_written_report_equals_its_sections(spark, sf0001, scratch, fixture):
    """Report.write takes seven sections from one scan; read one by one they are direct aggregates."""
    cfg = FIXTURES[fixture][1]
    report = reports.executive_report(enriched_readings(spark, sf0001, fixture), cfg)
    shared = report.to_write()
    assert list(shared) == list(report.sections) == list(reports.EXEC_TITLES)
    for title in reports.EXEC_TITLES:
        d, s = report[title], shared[title]
        assert s.dtypes == d.dtypes, title
        assert [tuple(x) for x in s.collect()] == [tuple(x) for x in d.collect()], title


def test_seven_sections_take_one_scan(spark, sf0001):
    r = enrich(r0(spark, sf0001), REFERENCE)  # a configured threshold: no statistics pass
    tree = moments.executive_moments(r, REFERENCE)._jdf.queryExecution().executedPlan().toString()
    assert tree.count("FileScan") == 1 and tree.count("Expand") == 1
    # raw readings are grouped into cells before the sets multiply rows
    assert tree.index("Expand") < tree.index("HashAggregate(keys=[traffic_date") < tree.index("FileScan")


def r0(spark, sf):
    from hourwise.sources.readings import from_events

    return from_events(spark, sf)


def test_one_section_builds_one_section(spark, monkeypatch):
    made = []
    for n, s in list(moments.SECTIONS.items()):
        spy = moments.Section(s.keys, lambda m, c, n=n, s=s: made.append(n) or s.project(m, c))
        monkeypatch.setitem(moments.SECTIONS, n, spy)
    report = reports.executive_report(enrich(micro_readings(spark), REFERENCE), REFERENCE)
    assert made == []
    first = report[reports.EXEC_TITLES[3]]
    assert made == ["exec_weekday_weekend"] and report[reports.EXEC_TITLES[3]] is first


def test_distinct_days_take_one_exchange(spark, sf0001):
    kpi = views.monthly_kpi(enriched_readings(spark, sf0001, "O"), EVENTS.with_(spike_threshold=1))
    tree = kpi._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", tree)) == 1


def test_single_view_registered(spark):
    spark.catalog.dropTempView("vw_monthly_kpi")
    made = views.register_views(enrich(micro_readings(spark), REFERENCE), REFERENCE, readings_view=None, names=["vw_hourly_pattern"])
    assert list(made) == ["vw_hourly_pattern"] and not spark.catalog.tableExists("vw_monthly_kpi")


def test_repeated_write_logs_once(spark, scratch):
    log = AuditLog(spark, os.path.join(scratch, "log"))
    r = enrich(micro_readings(spark), REFERENCE)
    report = reports.daily_report(r, REFERENCE, "2021-01-03")
    report.write(os.path.join(scratch, "out"), log)
    first = log.read().collect()
    report.write(os.path.join(scratch, "out"), log)  # the whole run again, after a failure say
    assert log.read().collect() == first and len(first) == 1
    # a run that broke before its rows were committed is written
    os.makedirs(os.path.join(scratch, "log", "run_id=broken", "_temporary"))
    assert log.append([("q", "f")], run_id="broken") and not log.append([("q", "f")], run_id="broken")
    assert log.read().count() == 2
    reports.daily_report(r, REFERENCE, "2021-01-03").write(os.path.join(scratch, "out"), log)  # another run
    assert log.read().count() == 3
    with pytest.raises(ValueError):
        log.append([("q", "f")], run_id="../x")
