"""Time-first retrieval and data processing over message logs, on Spark DataFrames."""
