"""Incremental ingest of an upload folder."""
