"""Spark-native analytics for indoor captures, measurements and training text."""
