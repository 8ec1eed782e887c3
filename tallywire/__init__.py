"""Spark-native analytics for digitised time series, telemetry and training text."""
