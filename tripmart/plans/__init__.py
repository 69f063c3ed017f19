"""Composed queries (marts) and the registry of queries with their SQL oracles."""
