"""Data preparation, profiling and AutoML on Spark DataFrames."""
