"""Structured Streaming forms of the running reports."""
