"""Card-transaction analytics on Spark DataFrames."""
