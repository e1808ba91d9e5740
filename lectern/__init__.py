"""Search, organise and cross-reference a library of texts with Spark DataFrames."""
