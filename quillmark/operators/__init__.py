"""Operators of the record-analytics library."""
