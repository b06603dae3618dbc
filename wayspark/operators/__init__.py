"""Operators over trips: DataFrame in, DataFrame out."""
