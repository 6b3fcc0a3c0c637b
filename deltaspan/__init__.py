"""Spark-native comparison of a previous and a next evaluation period."""
