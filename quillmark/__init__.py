"""Evidence and record analytics on PySpark DataFrames."""
