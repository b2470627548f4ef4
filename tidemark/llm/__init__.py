"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; queries and oracle SQL are in :mod:`tidemark.llm.queries`.
"""
