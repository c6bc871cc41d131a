"""Spark-native statistics, econometrics and machine-learning operators."""

__version__ = "0.1.0"
