"""Spark-native analytics over collections of content-addressed, linked JSON records."""
