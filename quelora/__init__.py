"""Event-time queue analytics on Spark DataFrames and Structured Streaming."""
