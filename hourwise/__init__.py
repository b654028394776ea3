"""hourwise: Spark-native analytics for irregular, roughly hourly count series.

Layout:
  sources/    readings (CSV, Parquet test tables), enriched-table writer, audit log
  functions/  Column expressions (calendar, bands, shares, labels)
  operators/  enrich, summaries, trends, insights, scalable global windows
  plans/      views, parameterised reports, shared measures, query registry, SQL oracle
  streaming/  the same daily operators over a stream of readings
"""

from hourwise.config import EVENTS, ORDERS, REFERENCE, TrafficConfig  # noqa: F401
from hourwise.operators.enrich import enrich  # noqa: F401
