"""Detection evaluation and failure analysis on Spark DataFrames."""
