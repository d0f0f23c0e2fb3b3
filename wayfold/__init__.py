"""Spark-first ride analytics: telemetry aggregation, road scoring and route planning."""
