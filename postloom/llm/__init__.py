"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries`` holds the registered queries and their SQL.
"""
