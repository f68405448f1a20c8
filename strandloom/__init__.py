"""Strandloom: a PySpark-native engine for large collections of labelled sequences and texts."""

__version__ = "0.1.0"
