"""Learning-to-rank analytics on Spark DataFrames."""
