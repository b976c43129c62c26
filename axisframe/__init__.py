"""Spark-native analytics for labelled points and intervals on keyed one-dimensional axes."""

__version__ = "0.1.0"
