"""feedloom: syndication-feed analytics on Spark DataFrames."""
