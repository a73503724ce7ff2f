"""Spark-native analytics over library releases: API changes, dependencies and their clients."""

__version__ = "0.1.0"
