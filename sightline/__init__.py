"""Security-visibility analytics on Spark: DataFrames in, DataFrames out."""
