"""lexaspan: substring and corpus analytics on Spark DataFrames."""
