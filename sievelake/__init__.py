"""Curate text corpora and analyse model evaluations on Spark.

Operators take and return DataFrames; parameters are explicit; nothing is
collected to the driver unless a docstring states its bound.
"""
