"""tollspan: toll-detection analytics on Spark DataFrames."""
