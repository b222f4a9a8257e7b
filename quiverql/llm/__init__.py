"""Operators for large text corpora (training-data preparation).

Self-contained: nothing else in the library imports this subpackage.
Every operator takes and returns DataFrames; the queries registered for
the driver are in :mod:`quiverql.llm.catalog`.
"""
