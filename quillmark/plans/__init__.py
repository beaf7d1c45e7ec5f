"""Plans of the record-analytics library."""
