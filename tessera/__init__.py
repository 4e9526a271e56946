"""tessera: quad analytics on Spark DataFrames."""
