"""Spark-native ordering and analysis of the files of many source repositories."""

__version__ = "0.1.0"
