"""doctables: rebuild tables from recognised documents with PySpark DataFrames."""
