"""Graph and control-flow analytics on Spark DataFrames."""
