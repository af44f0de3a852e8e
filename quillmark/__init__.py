"""Spark-native analytics over grounded document evidence."""
