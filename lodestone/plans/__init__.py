"""Composites: whole searches, ingest batches and responses."""
