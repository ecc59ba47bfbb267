"""quarry: governed analytics on Spark DataFrames."""
