"""Score, select and study training data with Spark DataFrames."""
