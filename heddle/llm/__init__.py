"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  ``heddle.llm.catalog``
registers its queries.
"""
