"""Operators for training-data pipelines: quality, dedup, decontamination, mixing, archives."""
