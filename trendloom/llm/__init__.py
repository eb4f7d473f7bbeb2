"""Operators for preparing training data: each takes and returns DataFrames.

Nothing outside this subpackage imports it.
"""
