"""Spark-native engine for evaluating and curating the work of SQL-writing agents."""

__version__ = "0.1.0"
