"""Schema-checked sparse entities on Spark DataFrames."""
