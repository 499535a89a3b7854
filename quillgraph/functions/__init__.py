"""Paths and terms."""
