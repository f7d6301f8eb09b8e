"""Causal event-log analytics and queue replay on Spark DataFrames."""
