"""Calendar and band expressions of the enriched readings (all narrow, per-row)."""

from __future__ import annotations

from hourwise.config import DAY_NAMES, MONTH_NAMES, TrafficConfig


def _sql_names(names: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def calendar_sql(t: str, cfg: TrafficConfig) -> dict[str, str]:
    """The ten calendar columns derived from the reading time ``t``, as SQL expressions.

    ``traffic_week`` is the ISO-8601 week (mode-3 week of the original); ``iso_year`` is the
    year that week belongs to (2021-01-01 is week 53 of ISO year 2020), so grouping by
    ``(iso_year, traffic_week)`` never merges the two ends of a year.  Day and month names
    are full English names looked up by number (cheaper per row than formatting the
    timestamp); ``day_of_week`` is 1 = Sunday .. 7 = Saturday.

    Expression text lets ``DataFrame.selectExpr`` build the whole projection in one call
    to the JVM, where the Column API needs one call per function and literal.
    """
    lo, hi = cfg.business_hours
    weekend = ", ".join(str(d) for d in cfg.weekend_days)
    return {
        "traffic_year": f"year({t})",
        "traffic_month": f"month({t})",
        "month_name": f"element_at({_sql_names(MONTH_NAMES)}, month({t}))",
        "iso_year": f"extract(YEAROFWEEK FROM {t})",
        "traffic_week": f"weekofyear({t})",
        "traffic_date": f"to_date({t})",
        "hour_of_day": f"hour({t})",
        "day_of_week": f"dayofweek({t})",
        "day_name": f"element_at({_sql_names(DAY_NAMES)}, dayofweek({t}))",
        "is_weekend": f"CASE WHEN dayofweek({t}) IN ({weekend}) THEN 1 ELSE 0 END",
        "is_business_hr": f"CASE WHEN hour({t}) BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END",
    }


def traffic_category_sql(c: str, cfg: TrafficConfig) -> str:
    """Four half-open bands: ``< b1`` Low, ``< b2`` Medium, ``< b3`` High, else Peak."""
    b1, b2, b3 = cfg.bands
    return (f"CASE WHEN {c} < {b1} THEN 'Low' WHEN {c} < {b2} THEN 'Medium' "
            f"WHEN {c} < {b3} THEN 'High' ELSE 'Peak' END")
