"""Sources and sinks: readings (CSV, test tables, stored enriched table) and the audit log."""
