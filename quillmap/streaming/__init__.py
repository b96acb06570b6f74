"""Incremental variants for point streams."""
