"""Operators of a training-data pipeline: packing, deduplication, token files and counts, toxicity, licences, decontamination."""
