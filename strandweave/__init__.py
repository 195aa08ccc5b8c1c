"""Continuous subgraph matching on Spark DataFrames."""
