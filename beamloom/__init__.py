"""Spark-first engine for quantised multi-beam time-frequency telemetry."""
