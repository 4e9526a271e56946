"""Operators for training-data pipelines: tokenising, deduplication, sharding, mixing, privacy, quality, language."""
