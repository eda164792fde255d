"""Schemas, field types and documents."""
