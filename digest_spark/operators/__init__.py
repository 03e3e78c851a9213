"""Relational operators, DataFrame to DataFrame."""
