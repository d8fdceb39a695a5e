"""Sales revenue reports and loads on Spark DataFrames."""
