"""Streaming of the text-analytics engine."""
