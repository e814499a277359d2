"""Operators: DataFrame in, DataFrame out; see registry.OPERATORS."""
