"""Sources of the record-analytics library."""
