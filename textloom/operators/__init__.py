"""Operators of the text-analytics engine."""
