"""Process mining on Spark DataFrames."""
