"""Attributed knowledge graphs and training-data pipelines on Spark DataFrames."""
