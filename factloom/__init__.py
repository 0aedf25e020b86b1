"""Evidence-backed system analytics expressed as PySpark DataFrames."""
