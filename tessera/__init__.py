"""Telemetry analytics on Spark: DataFrame operators with observation-status semantics."""
