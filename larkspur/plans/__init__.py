"""Lazy queries."""
