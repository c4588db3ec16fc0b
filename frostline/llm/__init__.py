"""Operators for preparing language-model training data.

Each operator takes and returns DataFrames. Where rows go through Python, they do so in
Arrow batches inside tasks; partitioning, shuffles and joins are Spark's.
"""
