"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``queries`` registers one query per
operator.
"""
