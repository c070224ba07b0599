"""Spark-native analytics over a library of notes and the message stream feeding it."""

__version__ = "0.1.0"
