"""Dependency-graph analytics on Spark: facts, relational operators, graph loops and passes."""
