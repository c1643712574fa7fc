"""Operators of a training-data pipeline: search, deduplication, encoding, mixing, sharding."""
