"""Functions of the record-analytics library."""
