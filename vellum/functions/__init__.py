"""Part of the outline engine."""
