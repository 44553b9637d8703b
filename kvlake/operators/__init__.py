"""Operators over the change log: DataFrame in, DataFrame out."""
