"""lakeloom: analytics and training-data operators declared on Spark DataFrames."""
