"""Query modules on the driver tables (with DuckDB oracle SQL) and domain pipelines."""
