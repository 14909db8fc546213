"""Page-aware document analytics on Spark: every stage is a function from DataFrames to DataFrames."""
