"""Opinion and ballot analytics on Spark DataFrames."""
