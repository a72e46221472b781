"""Orchestrated queries: benchmark, reports, estimates, and their DuckDB twins."""
