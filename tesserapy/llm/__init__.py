"""Operators for training-data pipelines: dedup, filtering, search, mixing."""
