"""Labelling workloads on Spark: build them, score them, account for them."""

__version__ = "0.1.0"
