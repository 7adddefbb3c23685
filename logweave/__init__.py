"""Event-log analytics for EVM chains, built on Spark DataFrames and Structured Streaming."""
