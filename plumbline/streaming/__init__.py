"""Drift of a growing corpus as a stream."""
