"""Change-triggered stream analytics on Spark DataFrames."""
