"""Agent-session analytics on Spark DataFrames."""
