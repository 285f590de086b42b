"""heddle: a Spark-native knowledge-retrieval engine.

Every operator is a function from DataFrames (or Columns) to DataFrames (or
Columns), so that Catalyst plans a whole query at once.
"""
