"""Entity resolution and data preparation on Spark DataFrames."""
