"""Streaming of the record-analytics library."""
