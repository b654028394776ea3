"""The measured facts of FIXTURES.md section 3, reproduced by the operators."""

import pytest

from hourwise.config import EVENTS, ORDERS
from hourwise.operators import summaries
from hourwise.operators.enrich import spike_threshold_frame
from hourwise.plans import views
from hourwise.plans.catalog import base_readings, enriched_readings

E_FACTS = {  # rows, mean, stddev_pop, threshold, spikes, (Low, Medium, High, Peak)
    "sf0.001": (1000, 5005.0, 4752.7, 14510.5, 50, (92, 519, 374, 15)),
    "sf0.01": (10000, 4963.1, 4910.0, 14783.0, 496, (968, 5367, 3493, 172)),
}
O_FACTS = {"sf0.001": (1500, 1094, 80), "sf0.01": (15000, 2399, 80)}  # rows, distinct days, months


@pytest.mark.parametrize("sf", sorted(E_FACTS))
def test_event_fixture_facts(spark, sf):
    d = f"/root/testdata/{sf}"
    rows, mean, std, thr, spikes, bands = E_FACTS[sf]
    st = spike_threshold_frame(base_readings(spark, d, "E"), EVENTS).first()
    assert (st.mean_count, st.std_count, st.spike_threshold) == (mean, std, thr)
    r = enriched_readings(spark, d, "E")
    over = summaries.dataset_overview(r, EVENTS).first()
    assert over.total_records == rows
    cats = {x.traffic_category: x.record_count for x in summaries.category_distribution(r, EVENTS).collect()}
    assert tuple(cats[c] for c in ("Low", "Medium", "High", "Peak")) == bands
    assert views.spike_events(r, EVENTS).count() == spikes


@pytest.mark.parametrize("sf", sorted(O_FACTS))
def test_order_fixture_facts(spark, sf):
    rows, days, months = O_FACTS[sf]
    r = enriched_readings(spark, f"/root/testdata/{sf}", "O")
    kpi = views.monthly_kpi(r, ORDERS).collect()
    assert len(kpi) == months
    assert sum(x.hourly_readings for x in kpi) == rows
    assert sum(x.active_days for x in kpi) == days
