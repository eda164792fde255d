"""Filters, sorting and updates as Column expressions."""
