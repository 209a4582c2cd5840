"""treadle: code-intelligence analytics on PySpark DataFrames."""
