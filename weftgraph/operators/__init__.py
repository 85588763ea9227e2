"""Operators on facts and graphs: DataFrame in, DataFrame out."""
