"""Sources and sinks: driver Parquet tables, CSV, filing JSON."""
