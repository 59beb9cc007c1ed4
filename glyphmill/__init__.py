"""Sub-word text analytics on Spark DataFrames."""
