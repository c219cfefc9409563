"""Continuous ingest into the record store."""
