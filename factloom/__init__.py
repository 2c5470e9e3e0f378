"""Program-fact analytics on Spark DataFrames."""
