"""Message triage on Spark DataFrames."""
