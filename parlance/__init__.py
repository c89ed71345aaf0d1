"""Document-localization analytics on Spark DataFrames."""
