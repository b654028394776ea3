"""Analysis parameters.

Every constant the original analysis hard-codes is a field here, so the same operators
run on any count series.  A field left as ``None`` is computed from the data instead
(a one-row aggregate that Spark evaluates once per query as a scalar subquery).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values of the original analysis (they must stay equal for parity runs):
#   traffic bands: Low < 500 <= Medium < 5000 <= High < 20000 <= Peak
#   spike threshold 31549 (= mean 8591 + 2 x population std-dev 11479)
#   z-score mean 8591.0 and std-dev 11479.0
#   grand total 23995560, expected row count 2793
#   business hours 8..17 inclusive, weekend = day-of-week 1 (Sunday) and 7 (Saturday)
#   one bar character per 500 visits
REFERENCE_BANDS = (500, 5000, 20000)
REFERENCE_SPIKE_THRESHOLD = 31549
REFERENCE_MEAN = 8591.0
REFERENCE_STD = 11479.0
REFERENCE_TOTAL = 23995560
REFERENCE_EXPECTED_ROWS = 2793

# Display order of the bands and full English calendar names, fixed values:
CATEGORY_ORDER = ("Peak", "High", "Medium", "Low")
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September",
               "October", "November", "December")


@dataclass(frozen=True)
class TrafficConfig:
    """Parameters of one analysis run.

    bands           lower bounds of Medium, High, Peak (half-open, ``count < bound``)
    spike_threshold fixed threshold, or None for ``mean + spike_k * stddev_pop``
    spike_k         multiplier used when the threshold is computed
    z_mean, z_std   z-score centre / scale of the spike view; None = computed
    grand_total     divisor of "% of total reached" shares; None = real total
    bar_unit        visits per bar character in the hourly pattern
    business_hours  inclusive hour range flagged as business hours
    weekend_days    ``dayofweek`` values (1 = Sunday) flagged as weekend
    year_safe       group months / ISO weeks together with their (ISO) year
    expected_rows   optional row count the load check compares against
    """

    bands: tuple[int, int, int] = REFERENCE_BANDS
    spike_threshold: float | None = None
    spike_k: float = 2.0
    z_mean: float | None = None
    z_std: float | None = None
    grand_total: int | None = None
    bar_unit: int = 500
    business_hours: tuple[int, int] = (8, 17)
    weekend_days: tuple[int, ...] = (1, 7)
    year_safe: bool = True
    expected_rows: int | None = None

    def with_(self, **kw) -> "TrafficConfig":
        return replace(self, **kw)


# The original analysis, constants and all (parity mode).
REFERENCE = TrafficConfig(
    spike_threshold=REFERENCE_SPIKE_THRESHOLD,
    z_mean=REFERENCE_MEAN,
    z_std=REFERENCE_STD,
    grand_total=REFERENCE_TOTAL,
    expected_rows=REFERENCE_EXPECTED_ROWS,
    year_safe=False,
)

# Computed-statistics configurations for the two test-data fixtures.
EVENTS = TrafficConfig(bands=(500, 5000, 20000), spike_k=2.0)
ORDERS = TrafficConfig(bands=(100000, 250000, 400000), spike_k=1.5)
