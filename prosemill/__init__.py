"""Text preparation, simplification and evaluation on Spark DataFrames."""
