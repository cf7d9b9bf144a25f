"""threadlake: search and analysis of recorded conversations, on Spark DataFrames."""
