"""Analytics over recorded AI interactions, expressed as Spark DataFrames."""
