"""Lodeframe: a Spark-native hybrid retrieval and text-corpus engine."""

__version__ = "0.1.0"
