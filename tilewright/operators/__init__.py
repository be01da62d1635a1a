"""Relational operators on needs, sources, files, pixels and report lines."""
