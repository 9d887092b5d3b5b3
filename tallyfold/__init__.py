"""Observation-ledger analytics as DataFrame, SQL and Structured Streaming jobs."""
