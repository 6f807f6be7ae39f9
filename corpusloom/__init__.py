"""Spark-native search, duplicate and incremental-processing operators for large source-code and document collections."""

__version__ = "0.1.0"
