"""Spark-native ledger reconciliation and statute retrieval."""

__version__ = "0.1.0"
