"""Operators of a training-data pipeline: quality, archives, near copies, packing, leaks, shards, URLs, toxicity."""
