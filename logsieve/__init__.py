"""Command-log cleaning and corpus preparation on Spark DataFrames."""
