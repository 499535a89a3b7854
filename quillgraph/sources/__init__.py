"""Readers of graph data."""
