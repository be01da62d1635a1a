"""Planners and what follows from their plans."""
