"""Composed plans: views, parameterised reports, the shared measures, the query registry
(`catalog`, used by `__spark_entry__`) and the DuckDB oracle texts (`oracle`)."""
