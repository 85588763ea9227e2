"""Scalar functions over text, names and commands."""
