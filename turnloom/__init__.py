"""Temporal transcript analytics on Spark: interval joins, islands, label reconciliation, captions."""
