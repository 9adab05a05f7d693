"""Spark-native analytics over periodically sampled popularity data and web-request logs."""
