"""Loomline: corpus screening, note handling, telemetry and stream analytics on PySpark."""
