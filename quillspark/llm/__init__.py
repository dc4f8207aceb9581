"""Operators of a training-data pipeline: decontamination, deduplication, privacy, packing, scoring, search, archives."""
