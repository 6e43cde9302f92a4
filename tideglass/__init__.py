"""Trading-behaviour analytics on Spark DataFrames."""
