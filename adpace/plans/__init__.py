"""Compositions of operators: building and refreshing all tables."""
