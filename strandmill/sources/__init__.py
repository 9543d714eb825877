"""Readers, sinks and log ingestion."""
