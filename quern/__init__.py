"""Spark-native operators for text search, telemetry, event logs and text hygiene."""
