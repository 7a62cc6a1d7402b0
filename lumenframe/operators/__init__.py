"""Relational operators over detections, matches, evidence, metrics, stores and graphs."""
