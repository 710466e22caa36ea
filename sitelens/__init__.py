"""Website-audit analytics on Spark DataFrames."""
