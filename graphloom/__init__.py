"""A graph-analytics engine on Spark DataFrames."""
