"""Operators of a training-data pipeline: token files, filters, near-duplicates, packing, vector search."""
