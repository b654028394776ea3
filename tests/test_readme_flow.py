"""The workflow shown in the README runs as written: CSV import with the original
constants, views, a logged daily report, the stored enriched table and the shared
executive report."""

import os

from hourwise.config import REFERENCE
from hourwise.operators import summaries
from hourwise.operators.enrich import enrich
from hourwise.plans import reports, views
from hourwise.sources.audit import AuditLog
from hourwise.sources.readings import from_events, read_csv, read_enriched, write_csv, write_enriched


def test_readme_workflow(spark, sf0001, scratch):
    csv = os.path.join(scratch, "traffic.csv")
    write_csv(from_events(spark, sf0001), csv)
    r = enrich(read_csv(spark, csv), REFERENCE)
    assert summaries.hourly_pattern(r, REFERENCE).count() == 24
    views.register_views(r, REFERENCE)
    log = AuditLog(spark, os.path.join(scratch, "audit_log"))
    reports.daily_report(r, REFERENCE, "2024-01-03").write(os.path.join(scratch, "daily"), audit=log)
    write_enriched(read_csv(spark, csv), REFERENCE, os.path.join(scratch, "enriched"))
    stored = read_enriched(spark, os.path.join(scratch, "enriched"))
    assert reports.day_summary(stored, REFERENCE, "2024-01-03").first() == \
        reports.day_summary(r, REFERENCE, "2024-01-03").first()
    ex = reports.executive_report(stored, REFERENCE)
    ex.write(os.path.join(scratch, "executive"))
    assert sorted(d for d in os.listdir(os.path.join(scratch, "executive"))) == sorted(reports.EXEC_TITLES)
    assert [x.query_name for x in log.read().collect()] == ["sp_daily_report(2024-01-03)"]
