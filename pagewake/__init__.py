"""Web-change analytics on Spark DataFrames."""
