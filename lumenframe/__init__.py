"""Spark-first engine for text detections, geometry, evidence and review data."""
