"""Spark-native embedding retrieval: corpora, nearest neighbours, scoring, stores."""

__version__ = "0.1.0"
