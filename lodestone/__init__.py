"""Spark-native analytics over code repositories, commit histories, graphs, vectors and text corpora."""

__version__ = "0.1.0"
