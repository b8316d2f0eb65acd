"""Match-event analytics on Spark DataFrames."""
