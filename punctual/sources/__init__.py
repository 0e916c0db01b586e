"""Sources and sinks: the flights view over the test tables, CSV/parquet I/O, model persistence."""
