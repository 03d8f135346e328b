"""Reusable DataFrame operators: latest rows, trailing features, star joins, shares, checks."""
