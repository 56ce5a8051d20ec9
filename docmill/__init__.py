"""docmill: document analytics on Spark DataFrames."""
