"""Compositions of operators: feature recipes, reports, and the query catalog."""
