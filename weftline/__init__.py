"""Assembly-graph and alignment analytics on Spark DataFrames."""
