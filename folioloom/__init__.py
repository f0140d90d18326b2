"""folioloom: document analytics on Spark DataFrames."""
