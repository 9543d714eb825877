"""Behavioural-sequence features and ranking evaluation as Spark DataFrame jobs."""

__version__ = "0.1.0"
