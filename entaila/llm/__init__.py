"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names and returns a DataFrame; per-row Python runs only inside Spark
tasks, over Arrow batches cut into slices of bounded size.
"""
