"""Counterfactual nearest-neighbour analytics on Spark DataFrames."""
