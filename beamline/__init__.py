"""Analytics of document-derived engineering data on Spark DataFrames."""
