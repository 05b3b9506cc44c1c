"""Detector evaluation and dataset integrity as Spark DataFrame operations."""
