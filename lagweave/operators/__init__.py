"""Operators: DataFrame in, DataFrame out, no actions inside."""
