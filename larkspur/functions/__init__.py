"""Values, paths and JSON helpers."""
