"""Operators for training-data pipelines: deduplication, packing, secrets, mixing, search, classification and chat formatting."""
