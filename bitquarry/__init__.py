"""Bit-packed telemetry analytics on Spark."""
