"""Spark-native analytics over coded-audio streams and the tables around them."""
