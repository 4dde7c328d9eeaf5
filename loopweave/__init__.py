"""Loopweave: tandem-repeat analytics and corpus processing on Spark DataFrames."""
