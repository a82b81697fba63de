"""Operators of a training-data pipeline, each a function from DataFrames to a DataFrame.

Nothing outside this subpackage imports it. ``queries.py`` binds the operators to
the test tables; ``scratch.py`` holds what several operators share.
"""
