"""Joins, aggregates and models as DataFrame functions."""
