"""Text-compliance analytics on Spark DataFrames."""
