"""Scalar expressions as Columns."""
