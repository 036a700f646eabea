"""Set-at-a-time hybrid retrieval and memory maintenance on Spark DataFrames."""
