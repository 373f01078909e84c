"""MAP-hypervector analytics on Spark DataFrames."""
