"""A PySpark-native engine for review findings over code and text corpora."""

__version__ = "0.1.0"
