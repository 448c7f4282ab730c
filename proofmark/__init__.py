"""A label-compliance engine on DataFrames, Spark SQL and Structured Streaming."""
