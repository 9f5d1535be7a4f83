"""Spark-first retrieval, calibration and selective-prediction analytics."""

__version__ = "0.1.0"
