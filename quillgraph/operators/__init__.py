"""Operators over graphs, each a composition of DataFrame operations."""
