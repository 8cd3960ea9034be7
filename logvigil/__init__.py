"""Security-log analytics as Spark DataFrame jobs: ingest, detect, query, triage, report."""
