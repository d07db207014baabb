"""Operators of a training-data pipeline: filters, near-duplicates, packing, sharding, tokenizing."""
