"""Operators for large training-data pipelines.

Nothing else in the library imports this package. Each operator takes and returns DataFrames; the
registered queries over the given tables are in ``askgrid.llm.queries``.
"""
