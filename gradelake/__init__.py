"""gradelake: evaluation analytics and data preparation on Spark DataFrames."""
