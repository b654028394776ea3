"""Column and SQL-expression helpers: calendar columns, bands, shares, labels, text bars."""
