"""Operators for training-data pipelines: deduplication, language, quality, scoring, packing and scans of documents."""
