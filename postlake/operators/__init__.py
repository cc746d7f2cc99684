"""Relational operators: filters, facets, top-k, merges, similarity."""
