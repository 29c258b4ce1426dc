"""Operators on change logs, file metadata and references."""
