"""Compositions of operators, domain views over the provided tables, and the query catalogue."""
