"""A multi-model analytics library on Spark DataFrames."""
